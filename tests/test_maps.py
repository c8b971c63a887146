"""The relational forms against the kernels, on random maps."""

import random

import pytest
from pyspark.sql import functions as F

from mosaica.functions import text as T
from mosaica.operators import kernels as K
from mosaica.operators import maps

SCHEMA = "doc int, seq int, out_start int, out_end int, src_start int, src_end int, kind string, rule string"


def _random(rng: random.Random, length: int):
    text = "".join(rng.choice("abc\n") for _ in range(length))
    cuts = sorted(rng.sample(range(length + 1), min(length, rng.randrange(0, 7)) // 2 * 2))
    return K.rewritten(text, [(a, b, "z" * rng.randrange(3), "r") for a, b in zip(cuts[::2], cuts[1::2], strict=True)])


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(5)
    out = []
    for doc in range(60):
        middle, first = _random(rng, rng.randrange(0, 30))
        cuts = sorted(rng.sample(range(len(middle) + 1), min(len(middle), 4) // 2 * 2))
        final, later = K.rewritten(middle, [(a, b, "y" * rng.randrange(3), "s") for a, b in zip(cuts[::2], cuts[1::2], strict=True)])
        out.append((doc, first, later, final))
    return out


def _table(spark, maps_):
    return spark.createDataFrame([(d, i, *s) for d, m in maps_ for i, s in enumerate(m)], SCHEMA)


def _rows(df):
    out = {}
    for r in df.orderBy("doc", "seq").collect():
        out.setdefault(r.doc, []).append(K.Segment(*r[2:]))
    return out


def test_composition_merging_packing(spark, cases):
    first, later = _table(spark, [(d, a) for d, a, _, _ in cases]), _table(spark, [(d, b) for d, _, b, _ in cases])
    whole = maps.compose(first, later, ["doc"]).cache()
    want = {d: K.composed(a, b) for d, a, b, _ in cases}
    assert _rows(whole) == {d: m for d, m in want.items() if m}
    assert _rows(maps.merge(whole, ["doc"])) == {d: K.merged(m) for d, m in want.items() if m}
    assert _rows(maps.unpack(maps.pack(maps.collected(whole, ["doc"]), ["doc"]), ["doc"])) == {d: m for d, m in want.items() if m}
    lengths = spark.createDataFrame([(d, len(f), "characters") for d, *_, f in cases], "doc int, characters int, source_unit string")
    assert maps.faults(whole, lengths, ["doc"]).count() == 0


def test_unpacking_sorts_rows_without_the_tables_of_their_maps(spark):
    packed = spark.createDataFrame([(1, ["verbatim", "removal"], ["r"], [[2, 0, 2, 0, None], [0, 2, 5, 1, 0], [1, 5, 6, 0, None]])], "doc int, kinds array<string>, rules array<string>, rows array<array<int>>")
    found = maps.unpack(packed.repartition("doc"), ["doc"])
    assert sorted(map(tuple, found.collect())) == [(1, 0, 0, 2, 0, 2, "verbatim", None), (1, 1, 2, 2, 2, 5, "removal", "r"), (1, 2, 2, 3, 5, 6, "verbatim", None)]
    window = found._jdf.queryExecution().optimizedPlan().toString().split("+- Window", 1)[1].splitlines()[1]
    assert "kinds#" not in window.split("Generate")[0] and "array" not in window.split("Generate")[0]


def test_ranges(spark, cases):
    first = _table(spark, [(d, a) for d, a, _, _ in cases])
    asked = [(d, n, a, b) for d, m, _, _ in cases for n, (a, b) in enumerate((i, j) for i in range(0, (m[-1].out_end if m else 0) + 1, 3) for j in range(i, (m[-1].out_end if m else 0) + 1, 2))]
    ranges = spark.createDataFrame(asked, "doc int, range int, start int, end int")
    got = {(r.doc, r.range): (r.src_start, r.src_end) for r in maps.resolve(first, ranges, ["doc"]).collect()}
    by = {d: m for d, m, _, _ in cases}
    assert got == {(d, n): K.located(by[d], a, b) or (None, None) for d, n, a, b in asked}


def test_insertion_moves_the_map(spark):
    texts = ["", "body", "---\ntitle: x\n---\nbody", "---\nlayer: fact\nproducer: mosaica.sync/1\n---\n", "---\nopen", "a\n---\nb"]
    rows = spark.createDataFrame([(i, t, [tuple(s) for s in ([K.Segment(0, len(t), 5, 5 + len(t), "verbatim")] if t else [])]) for i, t in enumerate(texts)], f"i int, text string, s array<{maps.SEGMENT}>")
    b = T.insertion(F.col("text"), T.matter())
    out = rows.withColumn("b", b).select("i", "text", T.inserted(F.col("text"), F.col("b.at"), F.col("b.inserted")).alias("new"), T.shifted(F.col("s"), F.col("b.at"), F.col("b.inserted")).alias("m"))
    for r in out.collect():
        segments = [K.Segment(*s) for s in r.m]
        K.checked(segments, len(r.new))
        assert all(r.new[s.out_start : s.out_end] == r.text[s.src_start - 5 : s.src_end - 5] for s in segments if s.kind == "verbatim")
        assert ("layer: fact" in r.new) and r.new.count("producer:") == 1


@pytest.mark.parametrize(("text", "want"), [("---\ntitle: 'a'\n---\n# h", "a"), ("---\ntitle:\n---\n# h", ""), ("---\nx: 1\n...\n# h ", "h"), ("####### no\n###### yes", "yes"), ("---\ntitle: x\n# h", "h"), ("plain", None), ('---\ntitle: "open\n---', '"open')])
def test_titles(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(T.title(F.col("t"))).first()[0] == want


def test_keys(spark):
    rows = [(["a", "b"], "a/b", None), ([], None, "no_parts"), (["a", ""], None, "empty_part"), (["..", "a"], None, "climbs"), (["a/b"], None, "separator"), (["é"], "é", None)]
    got = spark.createDataFrame([(r[0],) for r in rows], "p array<string>").select(T.unit_key(F.col("p")), T.key_refusal(F.col("p"))).collect()
    assert [tuple(r) for r in got] == [r[1:] for r in rows]


def test_canonical_form():
    assert T.canonical({"b": [1, True, None], "a": "é\n", "\U0001f600": 1, "￮": 2}) == '{"a":"é\\n","b":[1,true,null],"😀":1,"￮":2}'
    with pytest.raises(TypeError):
        T.canonical({"a": 1.5})
