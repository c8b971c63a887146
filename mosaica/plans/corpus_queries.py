"""Queries over corpora and their history: comparison, reuse, withdrawal, journal, verification, citations, export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaica.functions import text
from mosaica.operators import convert, corpus, history
from mosaica.plans.registry import decorated, query, sql, table

_A, _B = f"(select path, sha256(text) as hash from {sql('snapshot1')})", f"(select path, sha256(text) as hash from {sql('snapshot2')})"
_COMPARED = f"""(select coalesce(a.path, b.path) as path, case when a.path is null then 'added' when b.path is null then 'removed' when a.hash = b.hash then 'unchanged' else 'changed' end as op, b.hash as hash, a.hash as previous
    from {_A} a full join {_B} b on a.path = b.path)"""


def _snapshot(spark, sf_dir: str, name: str) -> DataFrame:
    return decorated(spark, sf_dir, name).select("path", F.sha2("text", 256).alias("hash"))


def _compared(spark, sf_dir: str) -> DataFrame:
    return history.compared(_snapshot(spark, sf_dir, "snapshot1"), _snapshot(spark, sf_dir, "snapshot2"))


@query(f"select * from {_COMPARED}")
def compare_snapshots(spark, sf_dir):
    """Added, changed, unchanged, removed."""
    return _compared(spark, sf_dir)


@query(f"""with c as (select * from {_COMPARED}), g as (select previous as h, min(path) as old from c where op = 'removed' group by previous having count(*) = 1), n as (select hash as h, min(path) as new from c where op = 'added' group by hash having count(*) = 1)
           select old, new from g join n using (h)""")
def corpus_moves(spark, sf_dir):
    """What went and came with the same bytes, where either side has them once."""
    return history.moves(_compared(spark, sf_dir).withColumn("run", F.lit(1)), ["run"]).select("old", "new")


@query(f"with h as (select unnest([path, 't/' || path]) as path from {_A}), w as (select unnest([path, 't/' || path]) as path from {_B}) select path from h except select path from w")
def withdrawals(spark, sf_dir):
    """Files of a corpus that a run doesn't write."""
    both = lambda n: _snapshot(spark, sf_dir, n).withColumn("trace_path", F.concat(F.lit("t/"), "path"))
    return corpus.withdrawals(both("snapshot1"), both("snapshot2"))


@query(f"select b.path as unit_key, a.hash as source_hash from {_A} a join {_B} b on a.path = b.path and a.hash = b.hash where cast(split_part(b.path, '/', 2) as bigint) % 5 <> 0")
def incremental_reuse(spark, sf_dir):
    """Documents that need no conversion, as bytes, facts and converter are as before."""
    facts = F.array().cast("array<struct<key:string,value:string>>")
    other = F.split("path", "/")[1].cast("long") % 5 == 0
    held = _snapshot(spark, sf_dir, "snapshot1").select(F.col("path").alias("unit_key"), F.col("hash").alias("source_hash"), facts.alias("facts"), F.lit("markdown@1").alias("converter"), F.lit(0.0).alias("modified_at"))
    units = _snapshot(spark, sf_dir, "snapshot2").select(F.col("path").alias("unit_key"), F.col("hash").alias("source_hash"), facts.alias("facts"), F.when(other, "text@1").otherwise("markdown@1").alias("converter"), F.lit(1.0).alias("modified_at"))
    return corpus.reusable(units, held).select("unit_key", "source_hash")


# Journal


_C = sql("changes")
_MOVES = f"""(select g.entry_seq, old, new from (select entry_seq, previous as h, min(path) as old from {_C} where op = 'removed' group by entry_seq, previous having count(*) = 1) g
    join (select entry_seq, hash as h, min(path) as new from {_C} where op = 'added' group by entry_seq, hash having count(*) = 1) n on g.entry_seq = n.entry_seq and g.h = n.h)"""


def _entries(changes: DataFrame) -> DataFrame:
    n = F.col("entry_seq")
    parent = F.when(n % 7 == 0, F.lit("r0")).when(n > 1, F.concat(F.lit("r"), (n - 1).cast("string")))
    return changes.select("entry_seq").distinct().select("entry_seq", F.concat(F.lit("r"), n.cast("string")).alias("run_id"), parent.alias("parent"), F.concat(F.lit("t"), n.cast("string")).alias("created_at"), F.lit("sync").alias("kind"), F.lit(5).alias("unchanged"))


@query(f"""with c as (select entry_seq, count(*) filter (op = 'added') as a, count(*) filter (op = 'changed') as c, count(*) filter (op = 'removed') as r from {_C} group by entry_seq), m as (select entry_seq, count(*) as m from {_MOVES} group by entry_seq)
           select entry_seq, a - coalesce(m, 0) as added, c as changed, r - coalesce(m, 0) as removed, coalesce(m, 0) as moved, 5 as unchanged, a + c + r as touched, 5 + a + c as total from c left join m using (entry_seq)""")
def journal_changes(spark, sf_dir):
    """What each run did, moves counted once."""
    changes = decorated(spark, sf_dir, "changes")
    return history.summaries(_entries(changes), changes)


@query(f"""with f as (select path, arg_min(case when op = 'added' then 'absent' else previous end, entry_seq) as was, arg_max(case when op = 'removed' then 'absent' else hash end, entry_seq) as now from {_C} where entry_seq > 10 group by path)
           select path, case when was = 'absent' then 'added' when now = 'absent' then 'removed' else 'changed' end as op, nullif(now, 'absent') as hash, nullif(was, 'absent') as previous, true as exact from f where was <> now""")
def journal_fold(spark, sf_dir):
    """The net effect of all runs after the tenth."""
    return history.folded(decorated(spark, sf_dir, "changes"), since=10)


@query(f"""select 'journal 2' as invariant, 'r' || entry_seq as subject, entry_seq from (select distinct entry_seq from {_C}) where entry_seq > 1 and entry_seq % 7 = 0
           union all select 'journal 4', path, entry_seq from {_C} where op <> 'added' and entry_seq % 9 = 0""")
def journal_chain_check(spark, sf_dir):
    """A history that contradicts itself, in its chain or in what paths held."""
    changes = decorated(spark, sf_dir, "changes")
    wrong = changes.withColumn("previous", F.when((F.col("op") != "added") & (F.col("entry_seq") % 9 == 0), F.lit("zz")).otherwise(F.col("previous")))
    return history.chain_faults(_entries(changes), wrong)


@query(f"""with b as (select path, max(entry_seq) filter (op = 'added') as first_seen, max(entry_seq) as last_touched, arg_max(op, entry_seq) as last_op from {_C} group by path)
           select b.path, first_seen, last_touched, (select count(*) from {_C} c where c.path = b.path and c.op = 'changed' and c.entry_seq > b.first_seen) as revisions from b where last_op <> 'removed'""")
def blame(spark, sf_dir):
    """Which runs put each path where it is, names taken as they are."""
    return history.blame(decorated(spark, sf_dir, "changes"))


@query()
def blame_followed(spark, sf_dir):
    """The same, followed through moves."""
    return history.blame_followed(decorated(spark, sf_dir, "changes"))


@query(f"select distinct path, entry_seq from {_C}")
def log_touching(spark, sf_dir):
    """Q7: the runs that touched each path, by that name alone."""
    changes = decorated(spark, sf_dir, "changes")
    return history.touching(changes, changes, follow=False)


@query(f"""with recursive m as (select * from {_MOVES}), names as (select distinct path, path as name, cast(null as bigint) as until from {_C}
             union all select n.path, (select arg_max(old, entry_seq) from m where m.new = n.name and (n.until is null or m.entry_seq < n.until)), (select max(entry_seq) from m where m.new = n.name and (n.until is null or m.entry_seq < n.until))
             from names n where exists (select 1 from m where m.new = n.name and (n.until is null or m.entry_seq < n.until)))
           select distinct n.path, c.entry_seq from names n join {_C} c on c.path = n.name and (n.until is null or c.entry_seq <= n.until)""")
def log_followed(spark, sf_dir):
    """Q7: under all the names that a path had before."""
    changes = decorated(spark, sf_dir, "changes")
    return history.touching(changes, changes)


@query(f"""with e as (select distinct entry_seq from {_C}) select entry_seq, left(sha256('{{"created_at":"t' || entry_seq || '","parent":"' || case when entry_seq % 7 = 0 then 'r0' when entry_seq > 1 then 'r' || (entry_seq - 1) else '' end || '","run_id":"r' || entry_seq || '"}}'), 12) as entry, 't' || entry_seq as created_at
           from e order by entry_seq desc limit 5""")
def log_latest(spark, sf_dir):
    """The five latest runs with their short ids."""
    changes = decorated(spark, sf_dir, "changes")
    return history.log(_entries(changes), changes, limit=5).select("entry_seq", "entry", "created_at")


@query("select doc_id, case doc_id % 5 when 0 then null when 1 then 'contract' when 2 then 'run_id' when 3 then 'overlap' else 'bad_json' end as fault from documents")
def journal_parse(spark, sf_dir):
    """Lines of a journal, and what is wrong with them."""
    k = F.col("doc_id") % 5
    line = F.to_json(
        F.struct(
            F.when(k == 1, "other/1").otherwise(history.CONTRACT).alias("contract"), F.when(k == 2, "").otherwise(F.concat(F.lit("r"), F.col("doc_id").cast("string"))).alias("run_id"), F.array(F.lit("a"), F.lit("b")).alias("added"),
            F.when(k == 3, F.array(F.lit("b"))).otherwise(F.array(F.lit("c"))).alias("removed"), F.lit(1).alias("unchanged"),
        )
    )
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(k == 4, "{").otherwise(line).alias("line"))
    return history.parsed(rows, "doc_id").select("doc_id", "fault")


# Runs


def _mixed(spark, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 6
    body = F.when(k == 1, F.concat("text", F.lit("\0"))).when(k == 3, F.concat(F.lit("%PDF-1.4 "), "text")).otherwise(F.col("text"))
    kind = F.when(k == 2, "application/pdf").when(k == 3, "application/pdf").when(k == 4, "text/csv").when(k == 5, "text/html").otherwise("text/markdown")
    return convert.convert(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("unit_key"), kind.alias("media_type"), body.cast("binary").alias("content")))


_SKIPPED = "(select doc_id, case doc_id % 6 when 1 then 'undecodable' when 2 then 'not_a_pdf' when 3 then 'no_pages' when 4 then 'no_converter' end as reason from documents where doc_id % 6 between 1 and 4)"


@query(f"select reason, count(*) as n from {_SKIPPED} group by reason")
def skip_reasons(spark, sf_dir):
    """Why units gave no document."""
    return convert.skips(_mixed(spark, sf_dir), ["unit_key"]).groupBy("reason").agg(F.count("*").alias("n"))


@query("select case doc_id % 3 when 0 then 'utf-8' when 1 then 'utf-8-sig' else 'utf-16' end as encoding, false as detected, count(*) as n from documents group by all")
def encoding_histogram(spark, sf_dir):
    """A5: how the units of a run were read."""
    k = F.col("doc_id") % 3
    content = F.when(k == 0, F.encode("text", "utf-8")).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "utf-8"))).otherwise(F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "utf-16le")))
    done = convert.convert(table(spark, sf_dir, "documents").select(F.lit("text/plain").alias("media_type"), content.alias("content")))
    return done.groupBy(F.col("converted.encoding").alias("encoding"), F.col("converted.encoding_detected").alias("detected")).agg(F.count("*").alias("n"))


@query("""select count(*) as units_read, count(*) filter (doc_id % 6 = 0) as emitted, count(*) filter (doc_id % 6 <> 0) as skipped, sum(case when doc_id % 6 = 0 then length(text) else 0 end)::bigint as characters, sum(case when doc_id % 6 = 0 then length(text) else 0 end)::bigint as traceable_characters,
            sum(case when doc_id % 6 = 0 then length(text) else 0 end)::bigint as answered_source_units, ['characters'] as source_units, 1.0::double as traceable_coverage, 1.0::double as answer_width from documents where doc_id % 6 <> 5""")
def coverage_totals(spark, sf_dir):
    """The totals that a manifest states."""
    done = _mixed(spark, sf_dir).where("media_type <> 'text/html'")
    return corpus.totals(convert.documents(done).withColumn("source_unit", F.col("converted.source_unit")), convert.skips(done, ["unit_key"]))


@query("""with r as (select 'd/' || doc_id as path, sha256('{"path":"d/' || doc_id || '","unit_key":"' || doc_id || '","content_hash":"' || sha256(text) || '"}') as h from documents), l as (select left(h, 3) as lane, sha256(string_agg(h, '' order by path)) as d, count(*) as n from r group by left(h, 3))
          select sha256(string_agg(d, '' order by lane)) as digest, sum(n)::bigint as n from l""")
def run_identity(spark, sf_dir):
    """One hash over all artefacts of a run."""
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("path"), F.col("doc_id").cast("string").alias("unit_key"), F.sha2("text", 256).alias("content_hash"))
    return corpus.identity_digest(rows, ["path"], ["path", "unit_key", "content_hash"])


def _artefacts(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("unit_key"), F.lit("text/plain").alias("media_type"), F.col("text").cast("binary").alias("content"))
    docs = convert.documents(convert.convert(rows))
    c = F.col("converted")
    return docs.select("unit_key", F.concat(F.lit("documents/"), "unit_key").alias("path"), F.concat(F.lit("traces/"), "unit_key", F.lit(".json")).alias("trace_path"), c["text"].alias("text"), c["segments"].alias("segments"), text.content_hash(c["text"]).alias("content_hash"), text.content_hash(F.col("content")).alias("source_hash"),
                       c["source_unit"].alias("source_unit"), c["encoding"].alias("encoding"), c["bom_bytes"].alias("bom_bytes"), "characters", "traceable_characters", "answered_source_units", "converter", F.lit("fact").alias("layer"))


@query("""select 'documents/' || doc_id as subject, unnest(['content', 'trace 1']) as invariant from documents where doc_id % 19 = 0 union all select 'documents/' || doc_id, 'trace 5' from documents where doc_id % 23 = 0 union all select 'x' || doc_id, 'manifest 4' from documents where doc_id % 29 = 0
          union all select 'stray/' || doc_id, 'manifest 6' from documents where doc_id % 31 = 0 union all select 'gone/' || doc_id, 'manifest 3' from documents where doc_id % 37 = 0""")
def verify_faults(spark, sf_dir):
    """Stored documents, maps and records that don't agree."""
    rows, doc = _artefacts(spark, sf_dir), F.col("unit_key").cast("long")
    bad = rows.withColumn("text", F.when(doc % 19 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).withColumn("traceable_characters", F.col("traceable_characters") + F.when(doc % 23 == 0, 1).otherwise(0)).withColumn("path", F.when(doc % 29 == 0, F.concat(F.lit("x"), "unit_key")).otherwise(F.col("path")))
    found = corpus.artefact_faults(bad).withColumn("subject", F.when(F.col("subject").startswith("x") & (F.col("invariant") != "manifest 4"), F.concat(F.lit("documents/"), F.substring("subject", 2, 99))).otherwise(F.col("subject")))
    stray = rows.select("path").unionByName(rows.select(F.col("trace_path").alias("path"))).unionByName(table(spark, sf_dir, "documents").where("doc_id % 31 = 0").select(F.concat(F.lit("stray/"), F.col("doc_id").cast("string")).alias("path")))
    records = table(spark, sf_dir, "documents").where("doc_id % 37 = 0").select(F.concat(F.lit("gone/"), F.col("doc_id").cast("string")).alias("unit_key")).unionByName(rows.select("unit_key"))
    return found.unionByName(corpus.orphans(stray, rows)).unionByName(corpus.record_faults(records, rows)).select("subject", "invariant")


@query("""select 'documents/' || doc_id as path, k::bigint as range, case doc_id % 3 when 0 then 'source_changed' when 1 then 'source_missing' else 'resolved' end as status, ['verbatim'] as kinds, a::bigint as src_start, b::bigint as src_end, substr(text, a + 1, b - a) as excerpt,
            case when doc_id % 3 <> 1 then strlen(substr(text, 1, a)) end::bigint as byte_start, case when doc_id % 3 <> 1 then strlen(substr(text, 1, b)) end::bigint as byte_end
          from (select *, k * 30 as a, least(k * 30 + 12, length(text)) as b from documents, (values (0), (1)) t(k) where k * 30 < length(text))""")
def trace_citations(spark, sf_dir):
    """Citations led back to their sources, characters and bytes, and whether the source is still the same."""
    docs = _artefacts(spark, sf_dir)
    ranges = docs.select("path", F.length("text").alias("n"), F.explode(F.array(F.lit(0), F.lit(1))).alias("range")).where("range * 30 < n").select("path", "range", (F.col("range") * 30).alias("start"), F.least(F.col("range") * 30 + 12, "n").alias("end"))
    sources = table(spark, sf_dir, "documents").where("doc_id % 3 <> 1").select(F.col("doc_id").cast("string").alias("unit_key"), F.concat("text", F.when(F.col("doc_id") % 3 == 0, "!").otherwise("")).cast("binary").alias("content"))
    found = corpus.trace(docs, ranges, sources)
    return found.select("path", F.col("range").cast("long").alias("range"), "status", "kinds", *(F.col(c).cast("long").alias(c) for c in ("src_start", "src_end")), "excerpt", *(F.col(c).cast("long").alias(c) for c in ("byte_start", "byte_end")))


@query(f"""select 's:' || doc_id as id, length(text)::bigint as characters, sha256(text) as hash, (case doc_id % 5 when 0 then length('---.title: "Doc: ' || doc_id || '".layer: fact.---') + 1 when 2 then length('---.tags: x....') + 1 when 3 then length('---.title:.---') + 1 else 0 end)::bigint as body_offset from {sql("fronted")}""")
def export_columns(spark, sf_dir):
    """Documents as flat columns, with where their body begins."""
    rows = decorated(spark, sf_dir, "fronted").select(F.col("doc_id").cast("string").alias("unit_key"), "text", F.lit("h").alias("content_hash"), F.lit("c").alias("converter"), F.lit("fact").alias("layer"), F.length("text").cast("long").alias("characters"), F.length("text").cast("long").alias("traceable_characters"), F.lit("t").alias("trace_path"))
    return corpus.exported(rows, "s").select("id", "characters", F.sha2("text", 256).alias("hash"), "body_offset")


@query("""select doc_id, sha256('{"id":"s:' || doc_id || '","content":"' || sha256(text) || '","meta":{"source":"s","unit_key":"' || doc_id || '","content_hash":"h","converter":"c","layer":"fact","characters":64,"traceable_characters":64,"traceable_coverage":1.0,"trace_map":"t","corpus":"","body_offset":0}}') as hash from documents""")
def export_shapes(spark, sf_dir):
    """Q6: one line of JSON a document, in the shape that a reader takes."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("unit_key"), F.sha2("text", 256).alias("text"), F.lit("h").alias("content_hash"), F.lit("c").alias("converter"), F.lit("fact").alias("layer"), F.lit(64).alias("characters"), F.lit(64).alias("traceable_characters"), F.lit("t").alias("trace_path"))
    shaped = corpus.shaped(corpus.exported(rows, "s"), "haystack")
    return shaped.select(F.substring("id", 3, 99).cast("long").alias("doc_id"), F.sha2(F.to_json(F.struct(*shaped.columns), {"ignoreNullFields": "false"}), 256).alias("hash"))


@query("select 'traces/' || doc_id || '.json' as path, length(text)::bigint as characters, case when length(text) = 0 then 0 else 1 end::bigint as segments from documents")
def sidecars(spark, sf_dir):
    """Stored maps as JSON documents."""
    docs = _artefacts(spark, sf_dir).withColumn("origin", F.col("unit_key")).withColumn("media_type", F.lit("text/plain"))
    rows = corpus.sidecars(docs, "s")
    return rows.select("path", F.get_json_object("body", "$.coverage.characters").cast("long").alias("characters"), F.size(F.from_json(F.get_json_object("body", "$.segments"), "array<array<int>>")).cast("long").alias("segments"))


