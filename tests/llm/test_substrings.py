"""op1: compact windows by definition, planted passages, stars of copies, and the defined cases."""

import random
import tracemalloc

import numpy as np
import pytest

from mosaica.llm import substrings as S


@pytest.mark.parametrize(("n", "t"), [(5, 3), (40, 7), (200, 46), (46, 46), (300, 46), (20, 1)])
def test_windows_are_the_widest_stretches_around_their_least(n, t):
    rng = np.random.default_rng(n)
    for top in (5, 1000):
        h = rng.integers(0, top, n).astype(np.uint64)
        want = set()
        for c in range(n):
            low, high = c, c + 1
            while low > 0 and h[low - 1] > h[c]:
                low -= 1
            while high < n and h[high] >= h[c]:
                high += 1
            if high - low >= t:
                want.add((c, low, high))
        assert set(zip(*(x.tolist() for x in S.windows(h, t)), strict=True)) == want


class _Made:
    def __init__(self, seed):
        self.rng = random.Random(seed)

    def words(self, n):
        return [f"w{self.rng.randrange(20000)}" for _ in range(n)]

    def edited(self, words, edits):
        out = list(words)
        for slot in self.rng.sample(range(len(words) // 6), edits):
            out[6 * slot + 3] = f"e{self.rng.randrange(10**9)}"
        return out


def _run(spark, rows):
    return {r.doc_id: r for r in S.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_planted_passages_are_found_and_clean_texts_left_alone(spark):
    m = _Made(1)
    shared = [m.words(60) for _ in range(20)]
    rows, where = [], {}
    for i in range(160):
        own = m.words(m.rng.randrange(80, 300))
        if i < 80:
            p = shared[i % 20] if i < 60 else m.edited(m.edited(shared[i % 20], 0), 0)
            at = m.rng.randrange(len(own))
            where[i] = (at, at + 60)
            own[at:at] = p
        rows.append((i * 7, " ".join(own)))
    found = _run(spark, rows)
    for i in range(160):
        r = found[i * 7]
        if i >= 80:
            assert (r.n_near, r.n_partners, r.class_id, r.kept) == (0, 0, r.doc_id, True)
            continue
        at, end = where[i]
        covered = sum(max(0, min(end, s.end) - max(at, s.start)) for s in r.spans)
        assert covered == 60 and r.n_near <= 75
        assert r.class_id == (i % 20) * 7 and r.n_partners >= 1


def test_edited_passages_at_and_below_the_similarity(spark):
    m = _Made(2)
    rows, near = [], []
    for i in range(60):
        p = m.words(120)
        q = m.edited(p, 2 if i % 2 else 12)  # 106 of 126 shingles alike, or far fewer than 80 %
        rows += [(10 * i, " ".join(m.words(70) + p + m.words(70))), (10 * i + 1, " ".join(m.words(90) + q + m.words(30)))]
        near.append(i % 2 == 1)
    found = _run(spark, rows)
    assert [found[10 * i + 1].class_id == 10 * i and found[10 * i].n_near >= 100 for i in range(60)].count(True) >= sum(near) - 1
    assert sum(found[10 * i + 1].n_near > 0 for i in range(60) if not near[i]) <= 20  # a stretch without edits may be long enough by itself


def test_star_of_copies_near_the_original_alone(spark):
    m = _Made(3)
    original = m.words(300)
    rows = [(50_000, " ".join(original))] + [(m.rng.randrange(40_000) + k * 100_000 + 1, " ".join(m.edited(original, 7))) for k in range(150)]
    found = _run(spark, rows)
    least = min(i for i, _ in rows)
    assert all(r.class_id == least for r in found.values())


def test_defined_cases(spark):
    long = " ".join(_Made(4).words(50))
    very = " ".join(_Made(5).words(60_000)) + " " + long
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b c"), (5, "a b c"), (6, long), (7, long.upper().replace(" ", "\n")), (None, long), (8, very), (8, very), (None, "x y"), (9, " ".join(["same"] * 400)), (10, " ".join(["same"] * 300))]
    got = S.near_passages(spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, node string, spans int")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert [(by[i].n_near, by[i].class_id, by[i].kept) for i in (1, 2, 3, 4, 5)] == [(0, i, True) for i in (1, 2, 3, 4, 5)]
    assert by[6].class_id == by[7].class_id == by[8].class_id == 6 and by[6].n_near == 50 and not by[7].kept
    assert [(s.start, s.end) for s in by[8].spans] == [(60_000, 60_050)]
    assert {(r.n_near, r.class_id, r.kept) for r in got if r.doc_id is None} == {(50, None, True), (0, None, True)}
    assert by[10].class_id == 9
    assert S.near_passages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_least_places_have_windows_and_stretches_are_maximal():
    rng = np.random.default_rng(7)
    for n, t in ((30, 5), (400, 46)):
        h = rng.integers(1, 1 << 63, n).astype(np.uint64)
        assert S.least_places(h, t).tolist() == S.windows(h, t)[0].tolist()
    h[200] = 0
    both = [*S.windows(h[:200], t)[0].tolist(), *(S.windows(h[201:], t)[0] + 201).tolist()]
    assert S.least_places(h, t).tolist() == both
    for _ in range(200):
        flags = rng.random(60) < 0.8
        score = np.concatenate([[0], np.cumsum(np.where(flags, 1, -4))])
        found = S.stretches(flags, 4)
        sums = [int(score[b] - score[a]) for a, b in found]
        assert max(sums, default=0) == max(0, max(int((score[i:] - score[i]).max()) for i in range(61)))
        assert all(b <= c for (_, b), (c, _) in zip(found, found[1:], strict=False)) and all(x > 0 for x in sums)


def _near(x, y, t, percent):
    """Whether any stretches of t tokens or more have the similarity, by trying all."""
    for i in range(len(x) - t + 1):
        for j in range(i + t, len(x) + 1):
            u = set(x[i:j])
            for k in range(len(y) - t + 1):
                for end in range(k + t, len(y) + 1):
                    both = len(u.intersection(y[k:end]))
                    if 100 * both >= percent * (len(u) + len(set(y[k:end])) - both):
                        return True
    return False


def test_all_near_pairs_share_a_seed_and_are_verified():
    rng = random.Random(9)
    near = 0
    for _ in range(150):
        base = rng.sample(range(10**6), rng.randrange(8, 18))
        pair = []
        for _ in range(2):
            out = list(base)
            for _ in range(rng.randrange(3)):
                at, kind = rng.randrange(len(out)), rng.randrange(4)
                new = rng.sample(range(10**6, 10**7), rng.randrange(1, 4))
                out = [out[:at] + new + out[at + 1 :], out[:at] + out[at + 1 :], out[:at] + new + out[at:], out[at:] + out[:at]][kind] or new
            pair.append(np.array(rng.sample(range(10**7, 10**8), 2) + out + rng.sample(range(10**7, 10**8), 2), np.uint64))
        x, y = pair
        want = _near(x.tolist(), y.tolist(), 8, 80)
        assert bool(list(S.verified_passages(S._Text(S._six(x)), S._Text(S._six(y)), 8, 80))) == want
        if want:
            near += 1
            shared = np.isin(x, y), np.isin(y, x)
            seeds = [set(v[S.seeds_of(np.where(w, (v % np.uint64(7)).astype(np.int64), -1), np.zeros(len(v), bool), 8, 80)].tolist()) for v, w in zip(pair, shared, strict=True)]
            assert seeds[0] & seeds[1]
    assert near > 50


def test_no_near_pair_is_left_out(spark):
    m = _Made(11)
    rows, want = [], {}
    for k in range(60):
        p = m.words(50)
        q, r = m.words(52), m.words(52)
        # of 46 shingles 41 are alike: the least that suffices; two copies with other words between them; and a text whose copies are near to it alone
        pairs = [(p, [*p[:45], *m.words(5)]), (q + r, q + m.words(60) + r)]
        for n, (x, y) in enumerate(pairs):
            a = 100 * k + 10 * n
            rows += [(a, " ".join(m.words(20) + x + m.words(20))), (a + 1, " ".join(m.words(20) + y + m.words(20)))]
            want |= {a: a, a + 1: a}
    # b and c are near each other, a to neither, though it has tokens of both
    b = m.words(90)
    a = b[:40] + m.words(15) + b[40:80]
    c = [*b[:88], *m.words(2)]
    rows += [(10_001, " ".join(a)), (10_002, " ".join(b)), (10_003, " ".join(c))]
    want |= {10_001: 10_001, 10_002: 10_002, 10_003: 10_002}
    found = _run(spark, rows)
    assert {i: r.class_id for i, r in found.items()} == want


def test_repeats_of_one_token_count_once():
    rng = np.random.default_rng(12)
    for _ in range(400):
        t, v = int(rng.integers(1, 9)), np.repeat(rng.integers(0, rng.choice([3, 9, 99]), 14), rng.integers(1, 4, 14))
        bad, row = rng.integers(0, 99, 30) % 2 == 0, np.sort(rng.integers(0, 2, len(v)))
        isbad = bad[v % 30]
        order, gap = S.gaps(v.astype(np.uint64), row)
        assert (np.diff(v[order]) >= 0).all()
        assert gap.tolist() == [min((p - q for q in range(p) if v[q] == v[p] and row[q] == row[p]), default=0) for p in range(len(v))]
        mine = row == 0
        got = S.covered_once(np.where(isbad[mine], -80, 20), gap[mine], t)
        n = len(got)
        want = np.zeros(n, bool)
        for i in range(n):
            for j in range(i + t, n + 1):
                own = set(zip(v[i:j].tolist(), isbad[i:j].tolist(), strict=True))
                if sum(-80 if x else 20 for _, x in own) >= 0:
                    want[i:j] = True
        assert not (want & ~got).any()  # it may say more, not less
        assert (S.covered_once(np.where(isbad, -80, 20), np.zeros(len(v), np.int64), t) == S.covered(np.where(isbad, -80, 20), t)).all()


def test_texts_of_repeated_words_make_no_pairs(spark, monkeypatch):
    """Each repeats its own words, and one or two that all have: no two are near, and none may be compared with all others."""
    m = _Made(13)
    rows = []
    for i in range(120):
        runs = [[w] * 20 for w in m.words(8)]
        runs[4:4] = [["the"] * 20]
        own = m.words(30)  # a sentence said six times, after a line that all have
        rows += [(2 * i, " ".join(sum(runs, []))), (2 * i + 1, " ".join(["it", "was", "the", "same", "old", "line", "again", *own * 6]))]
    met, keep = [], S.common.written

    def written(df, name):
        out = keep(df, name)
        if name == "pairs" or name == "tried":
            met.append(out.count())
        return out

    monkeypatch.setattr(S.common, "written", written)
    found = _run(spark, rows)
    assert all((r.n_near, r.class_id) == (0, i) for i, r in found.items())
    assert sum(met) == 0


def test_a_block_of_texts_takes_little_memory_and_batches_of_pairs_are_small(spark):
    words = _Made(14).words(15_000)
    texts = [" ".join(words[i * 100 :] + words[: i * 100]) for i in range(90)] + ["", "a b"]
    packed, size = [S.zstandard.compress(t.encode()) for t in texts], sum(map(len, texts))
    S.common._powers.clear()
    tracemalloc.start()
    v, none, first = S._unpacked(packed, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * size, peak / size
    h, whole = S.tokens(np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0] + [len(t) for t in texts]), 5)
    assert first.tolist() == whole.tolist() and (v == h >> np.uint64(16))[~none].all() and none.sum() == 90 * 4 + 2
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with S._small_batches(spark):
        assert max(spark.range(0, 2000, 1, 1).mapInArrow(lambda rows: (b.slice(0, 1).set_column(0, "n", S.pa.array([b.num_rows])) for b in rows), "n long").toPandas()["n"]) == S._PAIRS
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
