"""The calls that most users need: convert a table or files, ask where text came from, build, read and check corpora."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaica import settings as _settings
from mosaica.errors import CredentialFoundError, SourceError
from mosaica.functions import screening, text
from mosaica.operators import convert as _convert
from mosaica.operators import corpus, history
from mosaica.sources import folders


def settings(start: str | None = None, **given: object) -> dict[str, _settings.Setting]:
    """The settings of a run that starts in a folder, with their origins."""
    return _settings.load(start, **given)


def media_type_of(path: str) -> str:
    """By suffix; an unknown one is a SourceError."""
    from mosaica.dims import MEDIA_TYPES

    found = MEDIA_TYPES.get(Path(path).suffix.lower())
    if found is None:
        raise SourceError(f"{path}: the suffix names no known format")
    return found


def convert(units: DataFrame, run: corpus.Settings | None = None) -> DataFrame:
    """Documents of units (path, content, and media_type unless the path's suffix tells it), with text and map; a credential that isn't allowed stops all of it."""
    run = run or corpus.Settings()
    if "media_type" not in units.columns:
        units = units.withColumn("media_type", folders.media_type(F.col("path")))
    hits = screening.findings(units.withColumn("peek", text.peeked(F.col("content").cast("binary"))), ["path"], "peek", run.tiers)
    allowed = units.sparkSession.createDataFrame([tuple(a.split(":", 1)) for a in run.allowed], "rule string, path string")
    bad = screening.gate(hits, allowed, "path").limit(1).collect()
    if bad:
        raise CredentialFoundError(f"{bad[0].rule} in {bad[0].path}")
    return _convert.convert(units, run.registry, run.pack).select("path", "media_type", "converter", "converted.*")


def where(documents: DataFrame, ranges: DataFrame) -> DataFrame:
    """Where ranges (path, range, start, end) of converted documents came from."""
    return corpus.where(documents, ranges)


def sync(spark: SparkSession, folder: str, into: str | None = None, *, dry: bool = False, withdraw_all: bool = False, **given: object) -> corpus.Outcome:
    """Build or renew the corpus of a folder by its settings; ``dry`` only says what that would do."""
    found = _settings.load(folder, **given)
    source = folders.opened(spark, found["source"].value, folder)
    return corpus.sync(source, into or str(Path(folder) / found["into"].value), _settings.of_run(found), dry=dry, withdraw_all=withdraw_all, spark=spark)


def documents(spark: SparkSession, destination: str) -> DataFrame:
    """All documents of a corpus."""
    return corpus.Corpus(spark, destination).table("documents")


def log(spark: SparkSession, destination: str, limit: int | None = None) -> DataFrame:
    """The runs of a corpus, newest first."""
    entries, changes = history.from_lines(corpus.Corpus(spark, destination).journal_lines())
    return history.log(entries, changes, limit)
