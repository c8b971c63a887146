"""Corpora: plan and sync with gates, reuse of what didn't change, withdrawal, history; verify, trace and export over what is stored.

A corpus is a folder (on a file system that all executors share) with ``runs/<run_id>-<n>/`` of Parquet tables (artefacts, skipped, removals, findings;
documents with text and map), ``journal/`` (one small JSON line a run) and ``current``, a pointer that is replaced in one step. A run writes beside the
current one, so a lost executor or driver leaves the old corpus whole. Documents that are reused are copied as rows, never converted again.
"""

from __future__ import annotations

import datetime
import json
import os
import shutil
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaica import dims, storage
from mosaica.errors import ContractError, CredentialFoundError, DifferentSourceError, EmptySourceError, EverythingSkippedError, InterruptedRunError, TraceError
from mosaica.functions import screening, text
from mosaica.operators import convert, history, maps

ENGINE = "1.0"
CONTRACT = "mosaica.sync-manifest/1-draft"
EMITTER = "tables@1"

_KEYED = "unit_key string, origin string, media_type string, source_hash string, modified_at double, facts array<struct<key:string,value:string>>, converter string"
DOCUMENTS = f"{_KEYED}, path string, trace_path string, content_hash string, text string, segments array<{maps.SEGMENT}>, source_length int, source_unit string, encoding string, bom_bytes int, encoding_detected boolean, characters long, traceable_characters long, answered_source_units long, layer string, title string"


@dataclass
class Settings:
    """What decides a run besides its source."""

    pack: dims.Ruleset = dims.CORE
    tiers: tuple[str, ...] = ("signatures",)
    registry: convert.Registry = field(default_factory=convert.standard)
    allowed: tuple[str, ...] = ()  # rule:unit_key
    version: str = ENGINE

    @property
    def screener(self) -> str:
        return "+".join(f"{t}@1" for t in self.tiers)

    def decided_by(self) -> dict:
        return {"engine": self.version, "rulesets": [[self.pack.id, self.pack.version]], "screener": self.screener, "emitter": EMITTER, "allowed": sorted(self.allowed)}


# Aggregates of a run


def totals(artefacts: DataFrame, skipped: DataFrame | None = None) -> DataFrame:
    """One row: units_read, emitted, skipped, characters, traceable_characters, answered_source_units, source_units, traceable_coverage, answer_width.

    Ratios are sums over sums; the width is null where source units are mixed or nothing answers.
    """
    counts = ["emitted", "skipped", "characters", "traceable_characters", "answered_source_units"]
    rows = artefacts.select(F.lit(1).alias("emitted"), F.lit(0).alias("skipped"), *counts[2:], F.when(F.col("traceable_characters") > 0, F.col("source_unit")).alias("unit"))
    if skipped is not None:
        rows = rows.unionByName(skipped.select(F.lit(1).alias("skipped")), allowMissingColumns=True)
    both = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts), F.sort_array(F.collect_set("unit")).alias("source_units"))
    width = F.when((F.size("source_units") <= 1) & (F.col("answered_source_units") > 0), F.col("answered_source_units") / F.col("traceable_characters"))
    return both.select((F.col("emitted") + F.col("skipped")).alias("units_read"), "emitted", "skipped", "characters", "traceable_characters", "answered_source_units", "source_units", maps.ratio("traceable_characters", "characters").alias("traceable_coverage"), width.alias("answer_width"))


def per_artefact(artefacts: DataFrame) -> DataFrame:
    """Artefacts with traceable_coverage (1 if empty) and answer_width (null if nothing answers)."""
    width = F.when(F.col("answered_source_units") > 0, F.col("answered_source_units") / F.col("traceable_characters"))
    return artefacts.select("*", maps.ratio("traceable_characters", "characters").alias("traceable_coverage"), width.alias("answer_width"))


def headline(t: dict, removals: int) -> str:
    """One line about a run; a run without characters isn't called traceable."""
    led = f"{t['traceable_coverage']:.1%} traceable" if t["characters"] else "no characters to trace"
    width = f", {t['answer_width']:.2f} answer width" if t["answer_width"] is not None else ""
    return f"{t['emitted']} emitted, {t['skipped']} skipped, {removals} removals, {led}{width}"


def identity_digest(rows: DataFrame, order: list[str], fields: list[str]) -> DataFrame:
    """digest, n: one hash over all rows, without gathering them: rows are hashed, then in order the hashes of each lane, then those of the lanes.

    A lane is the rows whose hashes start with the same three of 16 digits, so no task holds them all; 4,096 lane digests meet at the end.
    """
    one = F.sha2(F.to_json(F.struct(*(F.col(f).alias(f) for f in fields)), {"ignoreNullFields": "false"}), 256)
    each = rows.select(F.struct(*order).alias("o"), one.alias("h"))
    lane = each.groupBy(F.substring("h", 1, 3).alias("lane")).agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "h"))), lambda x: x.h), ""), 256).alias("d"), F.count("*").alias("n"))
    return lane.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lane", "d"))), lambda x: x.d), ""), 256).alias("digest"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def together(**work) -> dict:
    """The results of independent small jobs, run at the same time: a run's totals are many jobs over small tables."""
    with ThreadPoolExecutor(max(1, len(work))) as pool:
        started = {k: pool.submit(f) for k, f in work.items()}
        return {k: f.result() for k, f in started.items()}


def artefact_digest(artefacts: DataFrame) -> list:
    return list(identity_digest(artefacts, ["path"], ["path", "unit_key", "content_hash"]).first())


def skip_digest(skipped: DataFrame) -> list:
    return list(identity_digest(skipped, ["origin", "reason"], ["origin", "reason"]).first())


def run_id(source: dict, decided_by: dict, converters: list[str], artefacts: list, skipped: list) -> str:
    """Over exactly what decides the output: who read, with what, and (by their digests) each artefact and skip; a plan and its sync share it."""
    return text.hash_of({"source": source, "decided_by": decided_by, "converters": converters, "artefacts": artefacts, "skipped": skipped})


# The stored corpus


class Corpus:
    """Tables of a destination's current run."""

    def __init__(self, spark: SparkSession, destination: str):
        self.spark, self.destination = spark, Path(destination)
        self.pointer = self.destination / "current"

    @property
    def run(self) -> dict | None:
        if not self.pointer.is_file():
            return None
        found = json.loads(self.pointer.read_text())
        if found.get("contract") != CONTRACT:
            raise ContractError(f"the corpus states contract {found.get('contract')!r}")
        return found

    def table(self, name: str) -> DataFrame:
        run = self.run
        if run is None:
            raise ContractError(f"{self.destination} holds no corpus")
        path = str(self.destination / "runs" / run["folder"] / name)
        return self.spark.read.schema(DOCUMENTS).parquet(path) if name == "documents" else self.spark.read.parquet(path)

    def journal_lines(self) -> DataFrame:
        folder = self.destination / "journal"
        rows = [(int(p.stem), p.read_text().strip()) for p in sorted(folder.glob("*.json"))] if folder.is_dir() else []
        return self.spark.createDataFrame(rows, "entry_seq long, line string")

    @staticmethod
    def located(start: str) -> Path | None:
        """The nearest corpus at or above a path."""
        for p in (Path(start).resolve(), *Path(start).resolve().parents):
            if (p / "current").is_file() and (p / "runs").is_dir():
                return p
        return None


@dataclass
class Outcome:
    """What a plan or sync did."""

    run_id: str
    totals: dict
    removals: int
    kept: int
    withdrawn: list[str]
    refusals: list[tuple[str, str]]
    skipped: DataFrame
    documents: DataFrame

    @property
    def headline(self) -> str:
        return headline(self.totals, self.removals)


def reusable(units: DataFrame, held: DataFrame) -> DataFrame:
    """Held documents whose unit has the same bytes, facts and converter: an equi-join on the key. ``units``: unit_key, source_hash, facts, converter."""
    u = units.select("unit_key", F.col("source_hash").alias("h"), F.to_json("facts").alias("f"), F.col("converter").alias("c"), F.col("modified_at").alias("at"))
    met = held.join(u, "unit_key").where("h = source_hash and c = converter").where(F.col("f").eqNullSafe(F.to_json("facts")))
    return met.withColumn("modified_at", F.col("at")).drop("h", "f", "c", "at")


def withdrawals(held: DataFrame, written: DataFrame) -> DataFrame:
    """path: what a corpus holds (documents and their maps) and the run doesn't write."""
    both = lambda d: d.select(F.explode(F.array("path", "trace_path")).alias("path")).distinct()
    return both(held).join(both(written), "path", "left_anti")


def _prepared(source, settings: Settings, spark: SparkSession, stage: str, previous: Corpus | None):
    """Units read, screened, converted or reused; all written once to the staging folder."""
    found, skipped = source.discover()
    units = source.read(found).select("origin", text.unit_key(F.col("key_parts")).alias("unit_key"), text.key_refusal(F.col("key_parts")).alias("refusal"), "media_type", "modified_at", "facts", "content", text.content_hash(F.col("content")).alias("source_hash"))
    bad = units.where("refusal is not null").select("origin", "refusal").limit(1).collect()
    if bad:
        raise ContractError(f"{bad[0].origin}: no key can be made of it ({bad[0].refusal})")
    keys = units.select("unit_key", "origin")
    history.refuse_repeated(keys)
    named = units.withColumn("converter", settings.registry.name_for(F.col("media_type")))
    kept = None
    run = previous.run if previous else None
    fresh = named
    if run and run["decided_by"] == settings.decided_by():
        kept = reusable(named, previous.table("documents"))
        fresh = named.join(kept.select("unit_key"), "unit_key", "left_anti")
    hits = screening.findings(fresh.withColumn("peek", text.peeked(F.col("content"))), ["unit_key"], "peek", settings.tiers)
    write(hits, stage, "findings")
    allowed = spark.createDataFrame([tuple(a.split(":", 1)) for a in settings.allowed], "rule string, unit_key string")
    refused = screening.gate(spark.read.parquet(f"{stage}/findings"), allowed)
    clean = fresh.join(refused.select("unit_key").distinct(), "unit_key", "left_anti")
    done = convert.convert(clean.drop("refusal"), settings.registry, settings.pack).drop("content")
    write(done, stage, "converted")
    done = spark.read.parquet(f"{stage}/converted")
    docs = convert.documents(done)
    c = F.col("converted")
    block = text.insertion(c["text"], text.matter(F.col("facts")))
    # Markdown, and whatever has facts, states what the engine knows; other formats keep their text.
    states = (F.col("media_type") == "text/markdown") | (F.size("facts") > 0)
    block = F.when(states, block).otherwise(F.struct(F.lit(0).alias("at"), F.lit("").alias("inserted")))
    docs = docs.withColumn("block", block).withColumn("text", text.inserted(c["text"], F.col("block.at"), F.col("block.inserted"))).withColumn("segments", text.shifted(c["segments"], F.col("block.at"), F.col("block.inserted")))
    docs = docs.select(
        "unit_key", "origin", "media_type", "source_hash", "modified_at", "facts", "converter", F.concat(F.lit("documents/"), "unit_key").alias("path"), F.concat(F.lit("traces/"), "unit_key", F.lit(".json")).alias("trace_path"), text.content_hash(F.col("text")).alias("content_hash"), "text", "segments",
        c["source_length"].alias("source_length"), c["source_unit"].alias("source_unit"), c["encoding"].alias("encoding"), c["bom_bytes"].alias("bom_bytes"), c["encoding_detected"].alias("encoding_detected"), F.length("text").cast("long").alias("characters"), "traceable_characters", "answered_source_units",
        F.lit("fact").alias("layer"), text.title(c["text"]).alias("title"),
    )
    if kept is not None:
        docs = docs.unionByName(kept.select(docs.columns))
    write(docs, stage, "documents")
    struck = done.select("unit_key", F.explode("converted.removals").alias("r")).select("unit_key", "r.*")
    if kept is not None:
        struck = struck.unionByName(previous.table("removals").join(kept.select("unit_key"), "unit_key", "left_semi"))
    lost = skipped.select("origin", "reason", "detail").unionByName(convert.skips(done, ["unit_key"]).withColumnRenamed("unit_key", "origin"))
    lost = lost.unionByName(refused.groupBy("unit_key").agg(F.min("rule").alias("detail")).select(F.col("unit_key").alias("origin"), F.lit("credential").alias("reason"), "detail"))
    together(removals=lambda: write(struck, stage, "removals"), skipped=lambda: write(lost, stage, "skipped"))
    return refused, kept


def write(df: DataFrame, stage: str, name: str) -> None:
    df.write.parquet(f"{stage}/{name}")


def sync(source, destination: str, settings: Settings | None = None, *, dry: bool = False, withdraw_all: bool = False, created_at: str | None = None, spark: SparkSession | None = None) -> Outcome:
    """Build or renew the corpus of a source, or with ``dry`` say what that would do. Refusals leave what is there as it is.

    Gates, in this order: a credential, another source's corpus, everything skipped, an empty source.
    """
    spark = spark or SparkSession.getActiveSession()
    settings = settings or Settings()
    before = Corpus(spark, destination)
    run = before.run
    folder = uuid.uuid4().hex
    stage = f"{storage.run_dir(spark)}/plan-{folder}" if dry else str(Path(destination).resolve() / "runs" / folder)
    if not dry:
        os.makedirs(Path(destination) / "runs", exist_ok=True)
    try:
        refused, kept = _prepared(source, settings, spark, stage, before if run else None)
        docs = spark.read.schema(DOCUMENTS).parquet(f"{stage}/documents")
        skipped, removals = spark.read.parquet(f"{stage}/skipped"), spark.read.parquet(f"{stage}/removals")
        held = before.table("documents") if run else None
        got = together(
            sums=lambda: totals(docs, skipped).first().asDict(), hits=lambda: [(r.unit_key, r.rule) for r in refused.select("unit_key", "rule").distinct().limit(100).collect()],
            converters=lambda: sorted(r[0] for r in docs.select("converter").distinct().collect()), artefacts=lambda: artefact_digest(docs), skips=lambda: skip_digest(skipped),
            gone=lambda: sorted(r[0] for r in withdrawals(held, docs).limit(1000).collect()) if run else [], removals=removals.count, kept=lambda: kept.count() if kept is not None else 0,
        )
        sums, hits, gone = got["sums"], got["hits"], got["gone"]
        about = {"source_id": source.source_id, "adapter": source.adapter, "key_derivation": source.key_derivation}
        identity = run_id(about, settings.decided_by(), got["converters"], got["artefacts"], got["skips"])
        outcome = Outcome(identity, sums, got["removals"], got["kept"], gone, hits, skipped, docs)
        if dry:
            return outcome
        if hits:
            raise CredentialFoundError(f"{hits[0][1]} in {hits[0][0]}, and {len(hits) - 1} more")
        if not withdraw_all:
            if run and run["source"]["source_id"] != source.source_id:
                raise DifferentSourceError(f"the corpus is of {run['source']['source_id']}, not {source.source_id}")
            if sums["units_read"] and not sums["emitted"]:
                raise EverythingSkippedError(f"{sums['units_read']} units, and no document")
            if run and not sums["units_read"]:
                raise EmptySourceError(f"{source.source_id} has no units; {len(gone)} files would go")
        _promote(before, folder, run, outcome, about, settings, source, created_at)
        return outcome
    except BaseException:
        shutil.rmtree(stage, ignore_errors=True)
        raise


def _promote(before: Corpus, folder: str, run: dict | None, outcome: Outcome, about: dict, settings: Settings, source, created_at: str | None) -> None:
    spark, created_at = before.spark, created_at or datetime.datetime.now(datetime.UTC).isoformat()
    new = spark.read.schema(DOCUMENTS).parquet(str(before.destination / "runs" / folder / "documents")).select("path", F.col("content_hash").alias("hash"))
    old = before.table("documents").select("path", F.col("content_hash").alias("hash")) if run else spark.createDataFrame([], "path string, hash string")
    changed = history.compared(old, new)
    same = together(write=lambda: write(changed.where("op <> 'unchanged'"), str(before.destination / "runs" / folder), "changes"), same=lambda: changed.where("op = 'unchanged'").count())["same"]
    rows = spark.read.parquet(str(before.destination / "runs" / folder / "changes")).collect()  # a journal line names what changed: a run's changes, not the corpus
    names = lambda op: sorted(r.path for r in rows if r.op == op)
    parent = run["run_id"] if run else None
    line = {
        "contract": history.CONTRACT, "entry_id": text.hash_of({"run_id": outcome.run_id, "parent": parent or "", "created_at": created_at}), "run_id": outcome.run_id, "parent": parent, "created_at": created_at, "engine_version": settings.version, "kind": "sync",
        "added": names("added"), "changed": names("changed"), "removed": names("removed"), "unchanged": same, "hashes": {r.path: r.hash for r in sorted(rows) if r.op in ("added", "changed")}, "previous": {r.path: r.previous for r in sorted(rows) if r.op in ("changed", "removed")},
    }
    body = {"contract": CONTRACT, "folder": folder, "run_id": outcome.run_id, "kind": "sync", "created_at": created_at, "engine_version": settings.version, "source": about | {"root": str(getattr(source, "root", "")), "caps": list(getattr(source, "caps", ()))}, "decided_by": settings.decided_by(), "coverage": outcome.totals, "withdrawn": outcome.withdrawn, "limits": list(dims.LIMITS)}
    if not (before.destination / "runs" / folder / "documents").is_dir():
        raise InterruptedRunError("another run took the staging folder")
    aside = before.destination / f".current-{folder}"
    aside.write_text(json.dumps(body, ensure_ascii=False, indent=1))
    os.replace(aside, before.pointer)
    journal = before.destination / "journal"
    journal.mkdir(exist_ok=True)
    number = max((int(p.stem) for p in journal.glob("*.json")), default=-1) + 1
    (journal / f"{number:08}.json").write_text(json.dumps(line, ensure_ascii=False) + "\n")
    for other in (before.destination / "runs").iterdir():  # what the run before held, withdrawn documents included
        if other.name != folder:
            shutil.rmtree(other, ignore_errors=True)


def plan(source, destination: str, settings: Settings | None = None, **options) -> Outcome:
    """What a sync would do; the destination isn't touched."""
    return sync(source, destination, settings, dry=True, **options)


# Verify


def artefact_faults(documents: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """invariant, subject, detail over documents with text, segments, content_hash, characters, traceable_characters, source_unit: one row a fault, in one pass."""
    s = F.col("segments")
    starts = F.transform(s, lambda x, i: F.struct(x.alias("s"), F.when(i > 0, F.element_at(s, F.when(i > 0, i).otherwise(1).cast("int"))["out_end"]).otherwise(0).alias("before")))
    n = lambda x: x.out_end - x.out_start
    led = F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + F.when(x.kind != "synthetic", n(x)).otherwise(0))
    end = F.coalesce(F.try_element_at(s, F.lit(-1))["out_end"], F.lit(0))
    tests = {
        "content": text.content_hash(F.col("text")) != F.col("content_hash"), "trace 1": F.exists(starts, lambda x: x.before != x.s.out_start) | (end != F.length("text")),
        "trace 2": F.exists(s, lambda x: (x.out_end < x.out_start) | (x.src_end < x.src_start)), "trace 3": (F.col("source_unit") == "characters") & F.exists(s, lambda x: (x.kind == "verbatim") & (n(x) != x.src_end - x.src_start)),
        "trace 4": F.exists(s, lambda x: (x.kind == "removal") & (n(x) != 0)), "trace 5": led != F.col("traceable_characters"),
        "manifest 4": (F.col("path") != F.concat(F.lit("documents/"), F.col("unit_key"))) | (F.col("trace_path") != F.concat(F.lit("traces/"), F.col("unit_key"), F.lit(".json"))), "source unit": ~F.col("source_unit").isin(*dims.SOURCE_UNITS),
    }
    found = F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(True)), k) for k, t in tests.items())))
    return documents.select(F.col("path").alias("subject"), F.explode(found).alias("invariant")).select("invariant", "subject")


def orphans(files: DataFrame, artefacts: DataFrame) -> DataFrame:
    """manifest 6: files (path) that are no artefact's document or map."""
    named = artefacts.select(F.explode(F.array("path", "trace_path")).alias("path"))
    return files.join(named, "path", "left_anti").select(F.lit("manifest 6").alias("invariant"), F.col("path").alias("subject"))


def record_faults(removals: DataFrame, artefacts: DataFrame) -> DataFrame:
    """manifest 3: removals of units that no artefact came from."""
    return removals.join(artefacts.select("unit_key"), "unit_key", "left_anti").select(F.lit("manifest 3").alias("invariant"), F.col("unit_key").alias("subject")).distinct()


def total_faults(stated: dict, artefacts: DataFrame) -> list[tuple[str, str]]:
    """manifest 2 and 5: stated totals that the artefacts don't sum to."""
    real = totals(artefacts).first().asDict()
    out = [("manifest 2", f"coverage.{k}") for k in ("emitted", "characters", "traceable_characters", "answered_source_units") if stated.get(k) != real[k]]
    return out + [("manifest 5", "coverage.source_units")] * (sorted(stated.get("source_units") or []) != real["source_units"])


def verify(spark: SparkSession, destination: str) -> DataFrame:
    """invariant, subject: everything stored that contradicts itself; no rows if all holds."""
    corpus = Corpus(spark, destination)
    run = corpus.run
    if run is None:
        raise ContractError(f"{destination} holds no corpus")
    docs = corpus.table("documents")
    found = artefact_faults(docs).unionByName(record_faults(corpus.table("removals"), docs))
    about = {k: run["source"][k] for k in ("source_id", "adapter", "key_derivation")}
    got = together(converters=lambda: sorted(r[0] for r in docs.select("converter").distinct().collect()), artefacts=lambda: artefact_digest(docs), skips=lambda: skip_digest(corpus.table("skipped")))
    few = total_faults(run["coverage"], docs)
    if run_id(about, run["decided_by"], got["converters"], got["artefacts"], got["skips"]) != run["run_id"]:
        few.append(("manifest 1", "run_id"))
    entries, changes = history.from_lines(corpus.journal_lines())
    chain = history.chain_faults(entries, changes, docs.select("path", F.col("content_hash").alias("hash")), run["run_id"]).select("invariant", "subject")
    return found.unionByName(chain).unionByName(spark.createDataFrame(few, "invariant string, subject string"))


# Trace


def trace(documents: DataFrame, ranges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Every range (path, range, start, end) with status, kinds, rules, src_start, src_end, excerpt; and with ``sources`` (unit_key, content) bytes of the source.

    A batch of citations is one interval join. status: synthetic, resolved, source_changed, source_missing; a range past the end is a TraceError.
    """
    docs = documents.select("path", "unit_key", "text", "segments", "source_hash", "source_unit", "encoding", "bom_bytes", "characters")
    over = ranges.join(docs.select("path", "characters"), "path").where("end > characters or start > end or start < 0").limit(1).collect()
    if over:
        raise TraceError(f"[{over[0].start}:{over[0].end}] is outside {over[0].path}")
    asked = docs.join(ranges.select("path").distinct(), "path", "left_semi")
    segments = maps.exploded(asked, ["path"])
    led = maps.resolve(segments, ranges, ["path"])
    named = maps.passed(segments, ranges.select("path", "range", "start", "end"), ["path"]).select("path", "range", "kinds", "rules")
    rows = led.join(named, ["path", "range"]).join(asked.drop("segments", "characters"), "path").withColumn("excerpt", F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))).drop("text")
    if sources is None:
        rows = rows.withColumn("content", F.lit(None).cast("binary"))
    else:
        rows = rows.join(sources.select("unit_key", F.col("content").cast("binary").alias("content")), "unit_key", "left")
    synthetic = F.forall("kinds", lambda k: k == "synthetic")
    altered = text.content_hash(F.col("content")) != F.col("source_hash")
    plain = F.when(F.col("encoding").isin("utf-8", "utf-8-sig"), F.expr("try_validate_utf8(cast(substring(content, bom_bytes + 1) as string))"))
    readable = plain.isNotNull() & (F.col("source_unit") == "characters") & (F.col("src_end") <= F.length(plain))
    status = F.when(synthetic, "synthetic").when(F.col("content").isNull(), "source_missing").when(altered, "source_changed").otherwise("resolved")
    at = lambda c: F.when(readable, text.byte_offset(plain, F.col(c), F.col("bom_bytes")))
    return rows.select(*ranges.columns, status.alias("status"), "kinds", "rules", F.coalesce("src_start", F.lit(0)).alias("src_start"), F.coalesce("src_end", F.lit(0)).alias("src_end"), "source_unit", "excerpt", at("src_start").alias("byte_start"), at("src_end").alias("byte_end"))


def where(documents: DataFrame, ranges: DataFrame) -> DataFrame:
    """The question of one conversion, without sources: a segment that starts at the range's end counts as touched."""
    segments = maps.exploded(documents, ["path"])
    return maps.resolve(segments, ranges, ["path"]).join(maps.passed(segments, ranges.select("path", "range", "start", "end"), ["path"], inclusive_end=True).select("path", "range", "kinds", "rules"), ["path", "range"])


# Export


SHAPES = {"jsonl": ("id", "text", "metadata"), "langchain": ("id", "page_content", "metadata"), "llamaindex": ("id_", "text", "metadata"), "haystack": ("id", "content", "meta")}
COLUMNS = ["source", "unit_key", "content_hash", "converter", "layer", "characters", "traceable_characters", "traceable_coverage", "trace_map", "corpus", "body_offset"]


def exported(documents: DataFrame, source_id: str, root: str = "") -> DataFrame:
    """id, text and the metadata columns of all documents."""
    own = text.block(F.col("text"))
    return documents.select(
        F.concat(F.lit(source_id + ":"), "unit_key").alias("id"), "text", F.lit(source_id).alias("source"), "unit_key", "content_hash", "converter", "layer", "characters", "traceable_characters",
        maps.ratio("traceable_characters", "characters").alias("traceable_coverage"), F.col("trace_path").alias("trace_map"), F.lit(root).alias("corpus"), F.coalesce(F.length(own) + 1, F.lit(0)).cast("long").alias("body_offset"),
    )


def shaped(rows: DataFrame, shape: str = "jsonl") -> DataFrame:
    """The three columns that a reader of this shape builds its documents from."""
    if shape not in SHAPES:
        raise ContractError(f"no export shape is called {shape!r}; there are {', '.join(SHAPES)}")
    i, t, m = SHAPES[shape]
    return rows.select(F.col("id").alias(i), F.col("text").alias(t), F.struct(*COLUMNS).alias(m))


def export(corpus: Corpus, path: str, shape: str = "jsonl") -> None:
    """Write all documents: JSON Lines in a shape, or ``parquet`` with flat columns."""
    rows = exported(corpus.table("documents"), corpus.run["source"]["source_id"], str(corpus.destination))
    if shape == "parquet":
        rows.write.parquet(path)
    else:
        shaped(rows, shape).write.option("ignoreNullFields", "false").json(path)


def sidecars(documents: DataFrame, source_id: str) -> DataFrame:
    """path, body: the map of each document as a stored JSON document, segments as rows of numbers."""
    packed = maps.pack(documents, ["path", "trace_path", "content_hash", "unit_key", "origin", "source_hash", "media_type", "encoding", "bom_bytes", "converter", "source_unit", "characters", "traceable_characters"])
    body = F.struct(
        F.lit("mosaica.trace-map/1").alias("contract"), F.struct("path", "content_hash").alias("artefact"), F.struct(F.lit(source_id).alias("source_id"), "unit_key", "origin", F.col("source_hash").alias("content_hash"), "media_type", "encoding", "bom_bytes").alias("source"), "converter", "source_unit",
        F.struct("characters", F.col("traceable_characters").alias("traceable")).alias("coverage"), F.array(*map(F.lit, ("out_length", "src_start", "src_end", "kind", "rule"))).alias("segment_fields"), "kinds", "rules", F.col("rows").alias("segments"),
    )
    return packed.select(F.col("trace_path").alias("path"), F.to_json(body, {"ignoreNullFields": "false"}).alias("body"))
