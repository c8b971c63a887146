"""op3: hot groups in which each copy is near the original alone."""

import random

from mosaica.llm import near_dedup


def _star(copies: int, seed: int, words: int = 300, edits: int = 7) -> list[tuple[int, str]]:
    """One original and copies with words of their own at ``edits`` places far apart: each a link to the original, few to each other."""
    rng = random.Random(seed)
    first = [f"w{seed}x{i}" for i in range(words)]
    ids = rng.sample(range(10**9), copies + 1)
    rows = [(ids[0], " ".join(first))]
    for k in range(copies):
        w = list(first)
        for slot in rng.sample(range(words // 6), edits):
            w[6 * slot + 4] = f"e{seed}x{k}x{slot}"
        rows.append((ids[k + 1], " ".join(w)))
    return rows


def _shingles(text: str, n: int) -> set:
    w = text.split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def _like(x: set, y: set) -> float:
    return len(x & y) / len(x | y)


def test_star_of_thousands_is_one_class(spark):
    rows = _star(2000, 1)
    sets = [_shingles(t, 4) for _, t in rows]
    assert all(100 * len(sets[0] & s) >= 80 * len(sets[0] | s) for s in sets[1:])
    assert sum(_like(sets[1], s) >= 0.8 for s in sets[2:300]) < 30
    found = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4, percent=80).collect()
    assert len(found) == len(rows)
    apart = sum(r.component_id != min(i for i, _ in rows) for r in found)
    assert apart == 0, f"{apart} of {len(rows)} documents lie outside the class"


def _brute(rows: list[tuple[int, str]], n: int, percent: int) -> dict[int, int]:
    sets = [(i, _shingles(t, n)) for i, t in rows]
    top = {i: i for i, _ in rows}

    def root(i: int) -> int:
        while top[i] != i:
            i = top[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if (u := root(i)) != (v := root(j)) and 100 * len(x & y) >= percent * len(x | y):
                top[max(u, v)] = min(u, v)
    return {i: root(i) for i, _ in rows}


def test_two_stars_chains_and_strangers_as_by_brute_force(spark):
    rows = _star(200, 2) + _star(150, 3, edits=13) + _star(150, 4, edits=5)
    rng = random.Random(9)
    rows += [(2 * 10**9 + k, " ".join(f"s{rng.randrange(5000)}" for _ in range(80))) for k in range(50)]
    found = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"), shingle=4, percent=80)
    assert {r.doc_id: r.component_id for r in found.collect()} == _brute(rows, 4, 80)
