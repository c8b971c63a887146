"""Queries over maps: line ends, composition, ranges, coverage, tiling, packing; HTML, PDF, alignment, reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaica import storage
from mosaica.functions import batches, text, urls
from mosaica.operators import convert, corpus, kernels, maps, reading
from mosaica.plans.registry import decorated, query, table


def _endings(more: str = "", tail: str = "") -> str:
    """CTEs up to ``segs``: the expected map of the line ends of a text with ``more`` behind it; ``tail`` adds segments."""
    return f"""
    pieces as (select doc_id, case when doc_id % 2 = 0 then 2 else 1 end as e, string_split(text{more}, chr(10)) as ps from documents),
    flat as (select doc_id, e, len(ps) as n, unnest(range(1, len(ps) + 1)) as i, unnest(ps) as p from pieces),
    spot as (select *, length(p) as l, coalesce(sum(length(p) + 1) over w, 0)::bigint as o, coalesce(sum(length(p) + e) over w, 0)::bigint as s
      from flat window w as (partition by doc_id order by i rows between unbounded preceding and 1 preceding)),
    raw as (select doc_id, i, 0 as part, o as out_start, o + l as out_end, s as src_start, s + l as src_end, 'verbatim' as kind, null as rule from spot where l > 0
      union all select doc_id, i, 1, o + l, o + l + 1, s + l, s + l + e, 'transformed', 'line_ending' from spot where i < n {tail}),
    segs as (select doc_id, row_number() over (partition by doc_id order by i, part) - 1 as seq, out_start, out_end, src_start, src_end, kind, rule from raw)"""


def _long(segments: DataFrame) -> DataFrame:
    return segments.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("seq", "out_start", "out_end", "src_start", "src_end")), "kind", "rule")


def _crlf(spark, sf_dir: str) -> DataFrame:
    return maps.ending_segments(decorated(spark, sf_dir, "crlf"), ["doc_id"])


@query(f"with {_endings()} select * from segs")
def ending_segments(spark, sf_dir):
    """The map of the line ends."""
    return _long(_crlf(spark, sf_dir))


_TAIL = """ union all select doc_id, n + 1, 0, o + l, o + l + 4 + d, s + l, s + l + 23 + d, 'transformed', 'url_query' from (select *, length(cast(doc_id as varchar)) as d from spot where i = n)
      union all select doc_id, n + 2, 0, o + l + 4 + d, o + l + 5 + d, s + l + 23 + d, s + l + 24 + d, 'verbatim', null from (select *, length(cast(doc_id as varchar)) as d from spot where i = n)"""


@query("with " + _endings(" || ' see https://e.test/p/' || doc_id", _TAIL) + " select * from segs")
def compose_maps(spark, sf_dir):
    """Line ends, then cleansing, as one map to the source; an interval join within each document."""
    rows = decorated(spark, sf_dir, "both")
    cleansed = rows.select("doc_id", urls.cleansing(text.normalized(F.col("text")))["segments"].alias("segments"))
    later = storage.written(maps.exploded(cleansed, ["doc_id"]), "later")  # the composition reads it three times; the kernel runs once
    whole = maps.compose(maps.ending_segments(rows, ["doc_id"]), later, ["doc_id"])
    return _long(maps.merge(whole, ["doc_id"]))


@query("with " + _endings(" || ' see https://e.test/p/' || doc_id", _TAIL) + " select doc_id, count(*) as n, sha256(string_agg(out_start || ',' || out_end || ',' || src_start || ',' || src_end || ',' || kind, ';' order by seq)) as digest from segs group by doc_id")
def compose_kernel(spark, sf_dir):
    """The same by the linear kernel, inside one conversion."""
    units = decorated(spark, sf_dir, "both").select("doc_id", F.lit("text/plain").alias("media_type"), F.col("text").cast("binary").alias("content"))
    s = F.col("converted.segments")
    line = F.transform(s, lambda x: F.concat_ws(",", x.out_start.cast("string"), x.out_end.cast("string"), x.src_start.cast("string"), x.src_end.cast("string"), x.kind))
    return convert.convert(units).select("doc_id", F.size(s).cast("long").alias("n"), F.sha2(F.array_join(line, ";"), 256).alias("digest"))


@query("select doc_id, 0::bigint as seq, 0::bigint as out_start, least(40, length(text))::bigint as out_end, 0::bigint as src_start, least(40, length(text))::bigint as src_end, 'verbatim' as kind, null as rule from documents where length(text) > 0 "
       "union all select doc_id, 1, 40, 40, 40, 41, 'removal', 'cut' from documents where length(text) > 40 union all select doc_id, 2, 40, length(text) - 1, 41, length(text), 'verbatim', null from documents where length(text) > 41")
def merge_verbatim(spark, sf_dir):
    """Pieces of ten characters, and one taken out, as the fewest segments."""
    cut = F.when(F.length("text") > 40, F.lit(1)).otherwise(0)
    n = F.ceil((F.length("text") - cut) / 10).cast("int")
    at = F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))).alias("i")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"), cut.alias("cut"), at)
    moved = F.when(F.col("i") >= 4, F.col("cut")).otherwise(0)
    low, high = F.col("i") * 10, F.least(F.col("i") * 10 + 10, F.col("n") - F.col("cut"))
    kept = rows.select("doc_id", (F.col("i") * 2).alias("seq"), low.alias("out_start"), high.alias("out_end"), (low + moved).alias("src_start"), (high + moved).alias("src_end"), F.lit("verbatim").alias("kind"), F.lit(None).cast("string").alias("rule"))
    gone = table(spark, sf_dir, "documents").where(F.length("text") > 40).select("doc_id", F.lit(7).alias("seq"), F.lit(40).alias("out_start"), F.lit(40).alias("out_end"), F.lit(40).alias("src_start"), F.lit(41).alias("src_end"), F.lit("removal").alias("kind"), F.lit("cut").alias("rule"))
    return _long(maps.merge(kept.unionByName(gone), ["doc_id"]))


_RANGES = "(select doc_id, text, k, least(length(text), k * 40) as a, least(length(text), k * 40 + 25) as b from documents, (values (0), (1), (2)) t(k) where k * 40 < length(text))"


def _asked(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("range")).where("range * 40 < n")
    return rows.select("doc_id", "range", F.least("n", F.col("range") * 40).alias("start"), F.least("n", F.col("range") * 40 + 25).alias("end"))


@query(f"""with r as (select *, case when doc_id % 2 = 0 then 1 else 0 end as m from {_RANGES})
           select doc_id, k::bigint as range, (a + m * (a - length(replace(substr(text, 1, a), chr(10), ''))))::bigint as src_start, (b + m * (b - length(replace(substr(text, 1, b), chr(10), ''))))::bigint as src_end from r""")
def resolve_ranges(spark, sf_dir):
    """What ranges of the output came from."""
    found = maps.resolve(_crlf(spark, sf_dir), _asked(spark, sf_dir), ["doc_id"])
    return found.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("range", "src_start", "src_end")))


@query(f"""with r as (select *, substr(text, a + 1, b - a) as s from {_RANGES}), f as (select *, contains(s, chr(10)) as nl, replace(s, chr(10), '') <> '' as other, s[1] = chr(10) as early from r)
           select doc_id, k::bigint as range, case when nl and other then case when early then ['transformed', 'verbatim'] else ['verbatim', 'transformed'] end when nl then ['transformed'] else ['verbatim'] end as kinds, case when nl then ['line_ending'] else [] end as rules from f""")
def ranges_pass(spark, sf_dir):
    """The kinds and rules that ranges pass through, in order of first meeting."""
    return maps.passed(_crlf(spark, sf_dir), _asked(spark, sf_dir), ["doc_id"]).select("doc_id", F.col("range").cast("long").alias("range"), "kinds", "rules")


@query(f"""with r as (select *, case when doc_id % 2 = 0 then 1 else 0 end as m from {_RANGES})
           select doc_id, k::bigint as range, (a + m * (a - length(replace(substr(text, 1, a), chr(10), ''))))::bigint as src_start, len(case when contains(substr(text, a + 1, b - a + 1), chr(10)) then ['x'] else [] end)::int as rules from r""")
def where_ranges(spark, sf_dir):
    """Q4: the question of one conversion, where a segment that starts at the end of the range is touched too."""
    rows = decorated(spark, sf_dir, "crlf")
    segments = maps.collected(maps.ending_segments(rows, ["doc_id"]), ["doc_id"]).withColumnRenamed("doc_id", "path")
    found = corpus.where(segments, _asked(spark, sf_dir).withColumnRenamed("doc_id", "path"))
    return found.select(F.col("path").alias("doc_id"), F.col("range").cast("long").alias("range"), F.col("src_start").cast("long").alias("src_start"), F.size("rules").alias("rules"))


@query("select doc_id, length(text)::bigint as characters, length(text)::bigint as traceable, (length(text) + case when doc_id % 2 = 0 then length(text) - length(replace(text, chr(10), '')) else 0 end)::bigint as answered, 1.0::double as coverage, "
       "case when length(text) = 0 then 1.0 else (length(text) + case when doc_id % 2 = 0 then length(text) - length(replace(text, chr(10), '')) else 0 end) / length(text) end::double as width from documents where length(text) > 0")
def trace_coverage(spark, sf_dir):
    """Characters, traceable ones, and how much source answers."""
    return maps.coverage(_crlf(spark, sf_dir), ["doc_id"])


_MUTATED = f"with {_endings()}, m as (select doc_id, seq, case when seq = 1 and doc_id % 3 = 0 then out_start + 1 else out_start end as out_start, out_end, src_start, src_end, kind from segs), l as (select *, coalesce(lag(out_end) over (partition by doc_id order by seq), 0) as before from m)"


@query(f"""{_MUTATED} select doc_id, seq::bigint as seq, 'gap_or_overlap' as fault from l where before <> out_start union all select doc_id, seq, 'backward' from l where out_end < out_start or src_end < src_start
           union all select doc_id, seq, 'verbatim_length' from l where kind = 'verbatim' and out_end - out_start <> src_end - src_start union all select doc_id, null, 'short' from documents where doc_id % 5 = 0""")
def tiling_violations(spark, sf_dir):
    """Maps that don't tile their text, and how."""
    broken = _crlf(spark, sf_dir).withColumn("out_start", F.when((F.col("seq") == 1) & (F.col("doc_id") % 3 == 0), F.col("out_start") + 1).otherwise(F.col("out_start")))
    lengths = table(spark, sf_dir, "documents").select("doc_id", (F.length("text") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)).alias("characters"), F.lit("characters").alias("source_unit"))
    return maps.faults(broken, lengths, ["doc_id"]).select("doc_id", F.col("seq").cast("long").alias("seq"), "fault")


@query(f"""with {_endings()}, f as (select *, first_value(kind) over (partition by doc_id order by seq) as k0 from segs)
           select doc_id, count(distinct kind)::int as kinds, count(distinct rule)::int as rules, sha256(string_agg((out_end - out_start) || ',' || src_start || ',' || src_end || ',' || case when kind = k0 then 0 else 1 end || ',' || case when rule is null then '-' else '0' end, ';' order by seq)) as digest from f group by doc_id""")
def pack_segments(spark, sf_dir):
    """Maps as tables of numbers."""
    packed = maps.pack(maps.collected(_crlf(spark, sf_dir), ["doc_id"]), ["doc_id"])
    line = F.transform("rows", lambda r: F.array_join(F.transform(r, lambda x: x.cast("string")), ",", "-"))
    return packed.select("doc_id", F.size("kinds").alias("kinds"), F.size("rules").alias("rules"), F.sha2(F.array_join(line, ";"), 256).alias("digest"))


@query(f"with {_endings()} select * from segs")
def unpack_segments(spark, sf_dir):
    """And back; output places are a running sum."""
    return _long(maps.unpack(maps.pack(maps.collected(_crlf(spark, sf_dir), ["doc_id"]), ["doc_id"]), ["doc_id"]))


@query(f"with {_endings()} select * from segs where doc_id % 2 = 0 union all select * from segs where doc_id % 2 = 1")
def read_sidecars(spark, sf_dir):
    """Stored maps in either layout, rows of numbers or one object a segment."""
    every = maps.collected(_crlf(spark, sf_dir), ["doc_id"])
    new = maps.pack(every.where("doc_id % 2 = 0"), ["doc_id"]).select("doc_id", F.to_json(F.struct("kinds", "rules", F.col("rows").alias("segments")), {"ignoreNullFields": "false"}).alias("body"))
    old = every.where("doc_id % 2 = 1").select("doc_id", F.to_json(F.struct(F.transform("segments", lambda s: F.struct(F.array(s.out_start, s.out_end).alias("out"), F.array(s.src_start, s.src_end).alias("src"), s.kind.alias("kind"), s.rule.alias("rule"))).alias("segments"))).alias("body"))
    return _long(maps.read_sidecar(new.unionByName(old), ["doc_id"]))


# HTML


def _units(rows: DataFrame, media_type: str) -> DataFrame:
    return rows.select("doc_id", F.lit(media_type).alias("media_type"), F.col("text").cast("binary").alias("content"))


def _pages(spark, sf_dir: str) -> DataFrame:
    return convert.convert(_units(decorated(spark, sf_dir, "paged"), "text/html"))


@query("select doc_id, sha256('# Doc ' || doc_id || chr(10) || chr(10) || text || chr(10) || chr(10)) as hash from documents")
def html_text(spark, sf_dir):
    """V4 to V9: pages as text with headings and breaks, without what frames it."""
    return _pages(spark, sf_dir).select("doc_id", F.sha2("converted.text", 256).alias("hash"))


@query("select * from (select unnest(['boilerplate.head', 'boilerplate.nav', 'boilerplate.footer']) as rule, unnest([1, 4, 10]) * n as characters, n as segments from (select count(*) as n from documents))")
def html_boilerplate_stats(spark, sf_dir):
    """V6, V7: what was left out of pages, by rule."""
    rows = maps.exploded(_pages(spark, sf_dir).select("doc_id", "converted.segments"), ["doc_id"])
    return rows.where("rule like 'boilerplate.%'").groupBy("rule").agg(F.sum(F.col("src_end") - F.col("src_start")).alias("characters"), F.count("*").alias("segments"))


@query("select doc_id, (2 * length(text) - length(replace(text, '&', '')) - length(replace(text, '<', '')))::bigint as entities from documents")
def entity_decode(spark, sf_dir):
    """V9: references made characters."""
    s = F.filter("converted.segments", lambda x: x.rule == "entity.reference")
    return _pages(spark, sf_dir).select("doc_id", F.size(s).cast("long").alias("entities"))


@query("""with d as (select *, length(cast(doc_id as varchar)) + 4 as h, length(text) - length(replace(text, '&', '')) as amp, length(text) - length(replace(text, '<', '')) as lt from documents)
          select source, count(*) as documents, sum(h + length(text) + 6)::bigint as characters, sum(h + length(text))::bigint as traceable, sum(h + length(text) + 4 * amp + 3 * lt)::bigint as answered,
            sum(h + length(text)) / sum(h + length(text) + 6) as coverage, sum(h + length(text) + 4 * amp + 3 * lt) / sum(h + length(text)) as width from d group by source""")
def coverage_by_source(spark, sf_dir):
    """A1 to A3 over V4: sums over sums, never means of ratios."""
    s = F.col("converted.segments")
    rows = _pages(spark, sf_dir).select("doc_id", F.length("converted.text").alias("c"), maps.traceable_in(s).alias("t"), maps.answered_in(s).alias("a")).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    sums = rows.groupBy("source").agg(F.count("*").alias("documents"), F.sum("c").alias("characters"), F.sum("t").alias("traceable"), F.sum("a").alias("answered"))
    return sums.select("*", maps.ratio("traceable", "characters").alias("coverage"), maps.ratio("answered", "traceable").alias("width"))


@query()
def html_segments(spark, sf_dir):
    """V4 to V10 on raw pages: their maps, row by row."""
    units = table(spark, sf_dir, "pages").select("page_id", F.lit("text/html").alias("media_type"), F.col("html").cast("binary").alias("content"))
    return maps.exploded(convert.convert(units).select("page_id", "converted.segments"), ["page_id"])


@query()
def flagship(spark, sf_dir):
    """Coverage of cleaned text per host: pages to text with map, cleansed, composed, summed."""
    units = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), F.lit("text/html").alias("media_type"), F.col("html").cast("binary").alias("content"))
    docs = convert.documents(convert.convert(units))
    sums = docs.groupBy("host").agg(F.count("*").alias("pages"), *(F.sum(c).alias(c) for c in ("characters", "traceable_characters", "answered_source_units")))
    return sums.select("*", maps.ratio("traceable_characters", "characters").alias("coverage"), maps.ratio("answered_source_units", "traceable_characters").alias("width"))


@query("select doc_id, 'Doc ' || doc_id || chr(10) || 'part' || chr(10) || ' two' || chr(10) as text, 1::bigint as pages from documents where doc_id % 3 = 0 union all select doc_id, 'a b' || chr(10) || 'c' || chr(10), 1 from documents where doc_id % 3 = 1 union all select doc_id, 'no_text_layer', null from documents where doc_id % 3 = 2")
def pdf_text(spark, sf_dir):
    """Simple PDF files; arrays with word gaps, escapes, hexadecimal strings, and a page without text."""
    own = F.concat(F.lit("BT (Doc "), F.col("doc_id").cast("string"), F.lit(") Tj 0 -14 Td <70617274> Tj ( \\164wo) Tj ET"))
    stream = F.when(F.col("doc_id") % 3 == 0, own).when(F.col("doc_id") % 3 == 1, F.lit("BT [(a) -250 (b)] TJ T* (c) Tj ET")).otherwise(F.lit("q 1 0 0 1 0 0 cm Q"))
    file = F.concat(F.lit("%PDF-1.4\n1 0 obj\n<< /Type /Page /Contents 2 0 R >>\nendobj\n2 0 obj\n<< >>\nstream\n"), stream, F.lit("\nendstream\nendobj\n"))
    units = table(spark, sf_dir, "documents").select("doc_id", F.lit("application/pdf").alias("media_type"), file.cast("binary").alias("content"))
    c = convert.convert(units).select("doc_id", "converted.*")
    return c.select("doc_id", F.coalesce("text", "reason").alias("text"), F.col("source_length").cast("long").alias("pages"))


@query("select doc_id, len(list_filter(string_split(text, chr(10)), lambda x: length(x) >= 12 and trim(x) <> ''))::bigint as matched, 0::bigint as missed from documents")
def align_lines(spark, sf_dir):
    """Lines of an extracted text found in its source, in order."""

    def counted(source, output):
        segments, hits, misses = kernels.aligned(source, output)
        kernels.checked(segments, len(output))
        return {"hits": hits, "misses": misses}

    count = batches.kernel(counted, "struct<hits:long,misses:long>")
    rows = decorated(spark, sf_dir, "crlf").withColumn("c", count("text", text.normalized(F.col("text"))))
    return rows.select("doc_id", F.col("c.hits").alias("matched"), F.col("c.misses").alias("missed"))


@query("""with l as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: length(x) >= 12 and trim(x) <> '') as ls from documents)
          select doc_id, case when len(ls) > 0 then sha256(array_to_string(ls, chr(10))) end as hash, case when len(ls) = 0 then 'no_main_content' end as reason from l""")
def external_converter(spark, sf_dir):
    """Any function from page to text, registered by name, gets a map by alignment."""
    registry = convert.standard()
    registry.offer("long_lines@1", convert.external(lambda t: "\n".join(x for x in t.split("\n") if len(x) >= 12 and x.strip())))
    units = _units(decorated(spark, sf_dir, "crlf"), "text/plain")
    c = convert.convert(units, registry.chosen({"text/plain": "long_lines@1"})).select("doc_id", "converted.*")
    return c.select("doc_id", F.when(F.col("reason").isNull(), F.sha2("text", 256)).alias("hash"), "reason")


def _placed(spark, sf_dir: str, name: str) -> DataFrame:
    x, y = 100 * (F.col("event_id") % 3) + F.col("event_id") % 7, 20 * (F.expr("event_id div 21") % 5) + F.expr("event_id div 105") % 3
    runs = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("n"), F.col("event_type").alias("text"), x.cast("double").alias("x"), y.cast("double").alias("y"))
    return reading.ordered(runs, ["user_id"], name).select("user_id", F.sha2("text", 256).alias("hash"))


_RUNS = "(select user_id, event_id, event_type, event_id % 3 as side, 100 * (event_id % 3) + event_id % 7 as x, event_id // 21 % 5 as base from events)"


@query(f"select user_id, sha256(string_agg(t, chr(10) order by base desc)) as hash from (select user_id, base, string_agg(event_type, ' ' order by x, event_id) as t from {_RUNS} group by user_id, base) group by user_id")
def reading_order_rows(spark, sf_dir):
    """Placed strings line by line."""
    return _placed(spark, sf_dir, "rows")


@query(f"select user_id, sha256(string_agg(t, chr(10) order by side, base desc)) as hash from (select user_id, side, base, string_agg(event_type, ' ' order by x, event_id) as t from {_RUNS} group by user_id, side, base) group by user_id")
def reading_order_columns(spark, sf_dir):
    """Column by column."""
    return _placed(spark, sf_dir, "columns")


