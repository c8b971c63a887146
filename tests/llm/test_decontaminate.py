"""op10 against brute force, and its defined cases."""

import hashlib
import random
import re

import pytest

from mosaica.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _brute(docs, items, window=10):
    wins = []
    for i, t in items:
        w = _words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.append((tuple(w[k : k + window]), i))
    out = []
    for d, t in docs:
        w, hit, met = _words(t), set(), set()
        for x, i in wins:
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit |= set(range(k, k + len(x)))
                    met.add(i)
        ids = sorted(i for i in met if i is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def _made(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["É1", "ab", "x"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(f"i{k}", text(rng.choice([1, 3, 9, 10, 14]) if k % 9 else 2)) for k in range(6)] + [("same", "alpha beta gamma"), ("same2", "Alpha, beta. gamma"), (None, "lone item here"), ("none", None), ("empty", "")]
    docs = [(k, text(rng.randrange(60))) for k in range(40)]
    docs += [(100, "so Alpha-BETA gamma, it's"), (101, "lone item here"), (102, None), (103, ""), (104, "  \n"), (105, "alphabeta gamma"), (106, docs[0][1]), (106, docs[0][1]), (107, items[3][1] + " " + items[3][1])]
    docs.append((108, " ".join(text(9) for _ in range(3000)) + " alpha beta gamma"))
    return docs, items


@pytest.mark.parametrize("most_words", [1_000_000, 15])
def test_as_brute_force(spark, most_words, monkeypatch):
    docs, items = _made()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    monkeypatch.setattr(D, "scan", lambda *a, f=D.scan, **o: f(*a, most_words=most_words, **o))
    assert sorted(map(tuple, D.digest(d, b).collect()), key=repr) == _brute(docs, items)


def test_spans_are_characters_of_the_original(spark):
    text = "Été! Alpha,\tBETA — gamma; fin"
    d, b = spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([("a", "alpha beta"), ("b", "gamma")], "item_id string, text string")
    row = D.scan(d, b).first().leak
    assert [text[s.start : s.end] for s in row.spans] == ["Alpha,\tBETA"] + ["gamma"] or [text[s.start : s.end] for s in row.spans] == ["Alpha,\tBETA", "gamma"]


def test_empty_tables_and_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a b", "x", 5)], "doc_id long, text string, leak string, found int")
    none = spark.createDataFrame([], "item_id string, text string")
    assert D.clean(d, none).collect() == d.collect()
    assert D.scan(d, none).columns == ["doc_id", "text", "found", "leak"]
    assert D.digest(d.limit(0), none).count() == 0
