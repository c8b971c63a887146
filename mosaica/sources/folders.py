"""Sources: a folder, a vault, a folder of fetched pages, and exported archives. Discovery opens nothing; reading is done by the executors.

A source gives two tables: ``found`` (origin, key_parts, media_type, size_bytes, modified_at, facts) and ``skipped`` (origin, reason,
detail); ``read`` adds ``content`` to found rows. Listing walks on the driver, as only names and sizes are looked at; folders are on a file
system that executors share.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from mosaica import dims
from mosaica.errors import SourceError

FOUND = "origin string, key_parts array<string>, media_type string, size_bytes long, modified_at double, facts array<struct<key:string,value:string>>"
SKIPPED = "origin string, reason string, detail string"
RECORD = ".fetch.json"
_FACTS = {"url": "source_url", "fetched_at": "fetched_at", "canonical_url": "canonical_url"}


def accepted(root: str) -> Path:
    """The root, if it is a folder somebody can mean; else SourceError."""
    path = Path(root).expanduser().resolve()
    if not path.is_dir():
        raise SourceError(f"{path} is no folder")
    if path in (path.parent, Path.home().resolve()):
        raise SourceError(f"{path} is a whole machine or home; name a folder in it")
    return path


def media_type(name, types: dict[str, str] = dims.MEDIA_TYPES):
    """Media type of a file name as a column; null if its suffix is unknown."""
    pairs = [F.lit(x) for p in sorted(types.items()) for x in p]
    return F.create_map(*pairs)[F.lower(F.regexp_extract(name, r"[^/.](\.[^./]+)$", 1))]


def walked(root: Path) -> Iterator[tuple[str, str | None, str, int, float]]:
    """origin, reason, detail, size, time of change: files and what isn't entered, sorted at every level."""
    for entry in sorted(root.iterdir(), key=lambda p: p.name):
        yield from _entry(root, entry)


def _entry(root: Path, entry: Path) -> Iterator[tuple[str, str | None, str, int, float]]:
    origin = entry.relative_to(root).as_posix()
    if entry.is_dir():
        if entry.name in dims.MACHINERY:
            yield origin, "machinery", entry.name, 0, 0.0
        elif entry.is_symlink():
            yield origin, "directory_symlink", "", 0, 0.0
        else:
            for child in sorted(entry.iterdir(), key=lambda p: p.name):
                yield from _entry(root, child)
    elif entry.is_symlink() and not _within(root, entry):
        yield origin, "outside_the_root", "", 0, 0.0
    else:
        stat = entry.stat()
        yield origin, None, "", stat.st_size, stat.st_mtime


def _within(root: Path, path: Path) -> bool:
    try:
        path.resolve().relative_to(root)
    except (OSError, ValueError):
        return False
    return True


def classed(listing: DataFrame, types: dict[str, str] = dims.MEDIA_TYPES, most: int = dims.MOST_BYTES) -> DataFrame:
    """A listing (origin, reason, detail, size_bytes, modified_at) with media_type, and reason for unknown formats and large files: columns only."""
    kind, suffix = media_type(F.col("origin"), types), F.regexp_extract(F.col("origin"), r"[^/.](\.[^./]+)$", 1)
    unknown, large = F.col("reason").isNull() & kind.isNull(), F.col("reason").isNull() & (F.col("size_bytes") > most)
    return listing.select(
        "origin", F.when(unknown, "unknown_format").when(large, "too_large").otherwise(F.col("reason")).alias("reason"),
        F.when(unknown, F.when(suffix == "", "(no suffix)").otherwise(suffix)).when(large, F.concat(F.col("size_bytes").cast("string"), F.lit(" bytes"))).otherwise(F.col("detail")).alias("detail"), kind.alias("media_type"), "size_bytes", "modified_at",
    )


class Folder:
    """Files of a folder, by suffix."""

    source_id, adapter, key_derivation, types = "filesystem", "filesystem@1", "path", dims.MEDIA_TYPES

    def __init__(self, spark: SparkSession, root: str, source_id: str | None = None):
        self.spark, self.root = spark, accepted(root)
        self.source_id = source_id or self.source_id
        self.caps = [f"files larger than {dims.MOST_BYTES} bytes are not read", "only these suffixes are read: " + ", ".join(sorted(self.types))]

    def listing(self) -> DataFrame:
        return classed(self.spark.createDataFrame(list(walked(self.root)), "origin string, reason string, detail string, size_bytes long, modified_at double"), self.types)

    def discover(self) -> tuple[DataFrame, DataFrame]:
        rows = self.listing()
        found = rows.where("reason is null").select("origin", F.split("origin", "/").alias("key_parts"), "media_type", "size_bytes", "modified_at", F.array().cast("array<struct<key:string,value:string>>").alias("facts"))
        return found, rows.where("reason is not null").select("origin", "reason", "detail")

    def read(self, found: DataFrame) -> DataFrame:
        """found with content. The containment of links is tested again where the file is opened."""
        root = self.root

        @F.udf("binary", useArrow=True)
        def content(origin):
            path = root / origin
            if not _within(root, path):
                raise SourceError(f"{origin} leads out of {root}")
            return path.read_bytes()

        return found.withColumn("content", content("origin"))


class Vault(Folder):
    """A folder of notes that an editor keeps."""

    source_id, adapter = "vault", "obsidian@1"


def with_facts(pages: DataFrame, records: DataFrame, origin: str = "origin") -> DataFrame:
    """Pages joined with fetch records (origin of the page, body): facts in a fixed order, and ``bad``: why a record can't be used.

    A record must be a JSON object whose known values are strings, neither blank nor broken over lines; unknown keys are left out.
    """
    rec = records.select(F.col("origin").alias(origin), F.col("body"), F.from_json("body", "map<string,string>").alias("m"))
    shape = F.regexp_extract("body", r"\A\s*(.)", 1)
    parsed = F.expr("try_parse_json(body)")

    def is_text(k: str):
        return F.coalesce(F.schema_of_variant(F.try_variant_get(parsed, f"$.{k}", "variant")) == "STRING", F.lit(False))

    bad = F.when(parsed.isNull() | (shape != "{"), "not a JSON object")
    for k in _FACTS:
        value = F.col("m")[k]
        there = F.array_contains(F.map_keys("m"), k)
        bad = bad.when(there & (~is_text(k) | (F.trim(F.coalesce(value, F.lit(""))) == "")), f"{k} is no bare string").when(there & value.rlike("[\r\n]"), f"{k} is broken over lines")
    facts = F.array_compact(F.array(*(F.when(F.array_contains(F.map_keys("m"), k), F.struct(F.lit(ours).alias("key"), F.btrim(F.col("m")[k], F.lit(" \t")).alias("value"))) for k, ours in _FACTS.items())))
    none = F.array().cast("array<struct<key:string,value:string>>")
    return pages.drop("facts").join(rec.select(origin, bad.alias("bad"), facts.alias("facts")), origin, "left").withColumn("facts", F.when(F.col("bad").isNull(), F.coalesce("facts", none)).otherwise(none))


def article(facts=None):
    """What a page is a copy of: its canonical address, else the one it was fetched from; null if neither is known."""
    facts = F.col("facts") if facts is None else facts
    of = lambda k: F.get(F.transform(F.filter(facts, lambda f: f.key == k), lambda f: f.value), F.lit(0))
    return F.coalesce(of("canonical_url"), of("source_url"))


def first_of_article(pages: DataFrame, article_col: str = "article", order: str = "origin") -> DataFrame:
    """Pages with ``duplicate_of``: the first page, in walk order, of the same article; null for that page and where the article is unknown.

    A window over the article, so a hot one is sorted in one task in spilled runs, of narrow rows: project first, join the pages later.
    """
    w = W.partitionBy(article_col).orderBy(order)
    first, n = F.first(order).over(w), F.row_number().over(w)
    return pages.withColumn("duplicate_of", F.when(F.col(article_col).isNotNull() & (n > 1), first))


class Fetched(Folder):
    """Fetched pages with records beside them; of an article the first page counts, and what is written is named .md."""

    source_id, adapter, key_derivation = "fetched", "fetched@1", "path, with the suffix of what is written"

    def discover(self) -> tuple[DataFrame, DataFrame]:
        rows = self.listing()
        is_record = F.col("origin").endswith(RECORD)
        found, skipped = rows.where(~is_record & F.col("reason").isNull()), rows.where(~is_record & F.col("reason").isNotNull()).select("origin", "reason", "detail")
        root = self.root

        @F.udf("string", useArrow=True)
        def body(origin):
            return (root / origin).read_bytes().decode("utf-8", "replace")

        records = rows.where(is_record & (F.col("reason") == "unknown_format")).select(F.expr(f"left(origin, length(origin) - {len(RECORD)})").alias("origin"), body("origin").alias("body"))
        known = with_facts(found, records)
        skipped = skipped.unionByName(known.where("bad is not null").select("origin", F.lit("bad_fetch_record").alias("reason"), F.col("bad").alias("detail")))
        judged = first_of_article(known.where("bad is null").withColumn("walk", F.split("origin", "/")).withColumn("article", article()), order="walk").withColumn("duplicate_of", F.array_join("duplicate_of", "/"))
        skipped = skipped.unionByName(judged.where("duplicate_of is not null").select("origin", F.lit("duplicate").alias("reason"), F.concat(F.lit("same article as "), "duplicate_of").alias("detail")))
        key = F.split(F.regexp_replace("origin", r"(?<=[^/])\.[^./]+$", ".md"), "/")
        return judged.where("duplicate_of is null").select("origin", key.alias("key_parts"), "media_type", "size_bytes", "modified_at", "facts"), skipped


MOST_DEEP, MOST_ENTRY = 4, 256 << 20
_PAGE_NAME = re.compile(r"(.*) ([0-9a-f]{32})", re.DOTALL)


def page_id(stem):
    """The 32 hexadecimal characters at the end of an exported page's name; empty without them."""
    return F.regexp_extract(stem, r"(?s)^.* ([0-9a-f]{32})$", 1)


class _Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _ArchiveReader(DataSourceReader):
    """One task for each outer archive: every entry is opened once, in the archive's order, so nothing is inflated twice."""

    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self):
        return [_Archive(p) for p in self.paths]

    def read(self, partition):
        yield from archive_entries(partition.path)


def _inflated(archive: zipfile.ZipFile, entry: zipfile.ZipInfo) -> bytes | None:
    """The entry's bytes; None when there are more than the bound, whatever the archive says about its size."""
    with archive.open(entry) as stream:
        body = stream.read(MOST_ENTRY + 1)
    return body if len(body) <= MOST_ENTRY else None


def archive_entries(path: str) -> Iterator[tuple]:
    """origin, key, media_type, size_bytes, content, reason, detail of all entries of an archive and the archives in it."""

    def walk(archive: zipfile.ZipFile, inside: str, depth: int):
        for entry in archive.infolist():
            if entry.is_dir():
                continue
            origin, name = f"{inside}!{entry.filename}", Path(entry.filename)
            suffix, reason, detail = name.suffix.lower(), None, ""
            named = _PAGE_NAME.fullmatch(name.stem)
            if suffix == ".zip":
                if depth >= MOST_DEEP:
                    reason, detail = "too_deep", f"{depth + 1} levels"
                elif (body := _inflated(archive, entry)) is None:
                    reason, detail = "too_large", f"more than {MOST_ENTRY} bytes"
                else:
                    try:
                        inner = zipfile.ZipFile(io.BytesIO(body))
                    except zipfile.BadZipFile as e:
                        reason, detail = "unreadable_archive", str(e)
                    else:
                        with inner:
                            yield from walk(inner, origin, depth + 1)
                        continue
            elif suffix not in dims.ARCHIVE_TYPES:
                reason, detail = "unknown_format", suffix or "(no suffix)"
            elif named is None:
                reason, detail = "no_page_id", "the name doesn't end in a page id"
            elif (body := _inflated(archive, entry)) is None:
                reason, detail = "too_large", f"more than {MOST_ENTRY} bytes"
            else:
                yield origin, named[2] + suffix, dims.ARCHIVE_TYPES[suffix], entry.file_size, body, None, ""
                continue
            yield origin, None, None, entry.file_size, None, reason, detail

    name = Path(path).name
    try:
        outer = zipfile.ZipFile(path)
    except zipfile.BadZipFile as e:
        yield name, None, None, 0, None, "unreadable_archive", str(e)
        return
    with outer:
        yield from walk(outer, name, 0)


class ArchiveSource(DataSource):
    """spark.read.format("page_archive").load(archive or folder of archives): entries with content, and what was skipped."""

    @classmethod
    def name(cls):
        return "page_archive"

    def schema(self):
        return "origin string, key string, media_type string, size_bytes bigint, content binary, reason string, detail string"

    def reader(self, schema):
        root = Path(self.options["path"]).expanduser().resolve()
        paths = [root] if root.is_file() else sorted(root.glob("*.zip")) if root.is_dir() else []
        if not paths:
            raise SourceError(f"{root} is no archive and holds none")
        return _ArchiveReader([str(p) for p in paths])


class Export:
    """Pages of an exported archive, or of a folder of them; keyed by the page id in their names."""

    source_id, adapter, key_derivation = "notion", "notion-export@1", "notion-page-id"

    def __init__(self, spark: SparkSession, root: str, source_id: str | None = None):
        self.spark, self.root = spark, Path(root).expanduser().resolve()
        self.source_id = source_id or self.source_id
        spark.dataSource.register(ArchiveSource)
        self.caps = [f"archives are followed {MOST_DEEP} levels deep", "only files whose name ends in a page id are read"]

    def _rows(self) -> DataFrame:
        return self.spark.read.format("page_archive").load(str(self.root))

    def discover(self) -> tuple[DataFrame, DataFrame]:
        rows = self._rows()
        found = rows.where("reason is null").select("origin", F.array("key").alias("key_parts"), "media_type", "size_bytes", F.lit(None).cast("double").alias("modified_at"), F.array().cast("array<struct<key:string,value:string>>").alias("facts"))
        return found, rows.where("reason is not null").select("origin", "reason", "detail")

    def read(self, found: DataFrame) -> DataFrame:
        return found.join(self._rows().where("reason is null").select("origin", "content"), "origin")


class Inline:
    """Units that are a table already: key_parts or a key, content (binary or string), media_type; further columns optional."""

    source_id, adapter, key_derivation, caps, root = "inline", "inline@1", "given", (), ""

    def __init__(self, units: DataFrame, source_id: str | None = None):
        self.source_id = source_id or self.source_id
        have = units.columns
        parts = F.col("key_parts") if "key_parts" in have else F.split("unit_key", "/")
        origin = F.col("origin") if "origin" in have else F.array_join(parts, "/")
        none = F.array().cast("array<struct<key:string,value:string>>")
        self.units = units.select(origin.alias("origin"), parts.alias("key_parts"), "media_type", F.octet_length("content").cast("long").alias("size_bytes"), (F.col("modified_at") if "modified_at" in have else F.lit(None)).cast("double").alias("modified_at"), (F.col("facts") if "facts" in have else none).alias("facts"), F.col("content").cast("binary").alias("content"))

    def discover(self) -> tuple[DataFrame, DataFrame]:
        return self.units.drop("content"), self.units.sparkSession.createDataFrame([], SKIPPED)

    def read(self, found: DataFrame) -> DataFrame:
        return self.units


SOURCES = {"fetched": Fetched, "filesystem": Folder, "notion": Export, "obsidian": Vault}


def opened(spark: SparkSession, kind: str, root: str):
    """A source by its name."""
    if kind not in SOURCES:
        raise SourceError(f"no source is called {kind!r}; there are {', '.join(sorted(SOURCES))}")
    return SOURCES[kind](spark, root)


def fetch_record(url: str, fetched_at: str, canonical_url: str | None = None) -> str:
    """A record as a fetcher writes it beside a page."""
    return json.dumps({"url": url, "fetched_at": fetched_at} | ({"canonical_url": canonical_url} if canonical_url else {}))
