"""op4: rows at the borders of tasks."""

import numpy as np
import pyarrow as pa
import pytest

from mosaica.llm import exact_substrings

NAMES = ["anchor", "context", "doc", "place"]


def _kinds(tasks: list[list[list[tuple]]]) -> list[tuple]:
    """(row, kind) of all rows that are judged a repeat or edge, over tasks of batches of sorted rows."""
    out = []
    for task in tasks:
        batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], NAMES) for rows in task]
        for b in exact_substrings._compare(iter(batches)):
            out += list(zip(*(c.to_pylist() for c in b.columns), strict=True))
    found = [r for r in out if r[4] > 0]
    borders = np.array(sorted(r for r in out if r[4] <= 0), np.int64)
    if len(borders):
        batch = pa.RecordBatch.from_arrays([*(pa.array(c) for c in borders[:, :4].T), pa.array(borders[:, 4], pa.int32())], [*NAMES, "kind"])
        for b in exact_substrings._compare_borders(iter([batch])):
            found += list(zip(*(c.to_pylist() for c in b.columns), strict=True))
    return sorted(found)


ROWS = [(1, 10, 1, 0), (2, 20, 1, 5), (3, 30, 2, 0), (4, 40, 2, 9)]


@pytest.mark.parametrize("tasks", [[[ROWS[:2]], [ROWS[2:]]], [[ROWS[:1], ROWS[1:2]], [ROWS[2:]]], [[ROWS[:3]], [ROWS[3:]]], [[ROWS]], [[[r]] for r in ROWS]])
def test_rows_without_an_equal_are_no_repeats(tasks):
    assert _kinds(tasks) == []


@pytest.mark.parametrize("at", [1, 2, 3])
def test_repeats_do_not_depend_on_the_tasks(at):
    rows = [(1, 10, 1, 0), (1, 10, 2, 5), (2, 20, 1, 0), (2, 21, 2, 0)]
    want = _kinds([[[(0, 0, 0, 0), *rows, (9, 9, 9, 9)]]])
    assert _kinds([[rows[:at]], [rows[at:]]]) == want != []


def _brute(texts: list[str | None], length: int) -> list[tuple[int, list[tuple[int, int]], bytes]]:
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for r in raw:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone[:-1].astype(int), [0]])))
        spans = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
        out.append((len(r), spans, bytes(b for b, g in zip(r, gone, strict=False) if not g)))
    return out


@pytest.mark.parametrize("most", [2000, 3])
def test_removed_bytes_as_by_brute_force(spark, most):
    rng = np.random.default_rng(11)
    letters = np.array(list("abcd é\n"))
    text = lambda n: "".join(rng.choice(letters, n))
    shared = [text(n) for n in (39, 40, 41, 70, 150)]
    texts = [text(int(rng.integers(0, 120))) + (shared[int(rng.integers(5))] if i % 3 else "") + text(int(rng.integers(0, 60))) for i in range(60)]
    texts += [shared[4]] * 4 + ["a" * 300, "ab" * 200, None, "", "x", text(20_000) + shared[3] + text(3) + shared[3], text(39)]
    texts += [t[:50] + "Z" + t[51:] for t in (text(120) for _ in range(1)) for _ in range(3)] + [shared[4][:75] + str(k) + shared[4][76:] for k in range(9)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, doc int, packed string")
    got = sorted((r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in exact_substrings.dedup(docs, length=40, most_contexts=most).collect())
    assert got == [(i, *row) for i, row in enumerate(_brute(texts, 40))]


def test_repeated_rows_missing_ids_and_empty_tables(spark):
    t = "".join(chr(97 + (i * i) % 26) for i in range(250)) + "end"
    docs = spark.createDataFrame([(1, t), (1, t), (None, t), (2, None)], "doc_id long, text string")
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in exact_substrings.digest(docs).collect()}
    assert got == {(1, 253, 253, 1), (None, 253, 253, 1), (2, 0, 0, 0)}
    assert exact_substrings.digest(docs.limit(0)).count() == 0
