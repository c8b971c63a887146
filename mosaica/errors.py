"""What can go wrong, as exceptions and as one table: exit code, outcome, and whether to ask again unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DONE, FAILED, USAGE, REFUSED = 0, 1, 2, 3


class EngineError(Exception):
    """Base of all; ``exit_code`` and ``retryable`` as in the table."""

    exit_code, retryable, detail = FAILED, False, ""

    @property
    def outcome(self) -> str:
        return "refused" if self.exit_code == REFUSED else "failed"


def _kind(name: str, detail: str, code: int = FAILED, retryable: bool = False) -> type[EngineError]:
    return type(name, (EngineError,), {"exit_code": code, "retryable": retryable, "detail": detail, "__doc__": detail, "__module__": __name__})


CredentialFoundError = _kind("CredentialFoundError", "A credential format was met that nobody has allowed; nothing was written.", REFUSED)
DifferentSourceError = _kind("DifferentSourceError", "The corpus there was built from another source; nothing was written.", REFUSED)
EmptySourceError = _kind("EmptySourceError", "The source has no units, and all of the corpus would go; nothing was written.", REFUSED)
EverythingSkippedError = _kind("EverythingSkippedError", "Units were read and none became a document; nothing was written.", REFUSED)
SourceError = _kind("SourceError", "A source isn't what it claims to be, or isn't there.")
ConversionError = _kind("ConversionError", "A unit gave text without a map to its source.")
TraceError = _kind("TraceError", "A map doesn't fit the document that it describes.")
ContractError = _kind("ContractError", "A stored document isn't of a known contract.")
Unverified = _kind("Unverified", "Stored invariants don't hold.")
InterruptedRunError = _kind("InterruptedRunError", "Another run took this one's staging area; running again repairs it.", retryable=True)
Unreadable = _kind("Unreadable", "The file system refused.", retryable=True)
Usage = _kind("Usage", "The arguments weren't understood.", USAGE)
Unexpected = _kind("Unexpected", "A fault of the engine itself.")

CATALOGUE = (CredentialFoundError, DifferentSourceError, EmptySourceError, EverythingSkippedError, SourceError, ConversionError, TraceError, ContractError, Unverified, InterruptedRunError, Unreadable, Usage, Unexpected)


def catalogue(spark: SparkSession) -> DataFrame:
    """kind, exit_code, outcome, retryable, detail: one row a kind of error."""
    return spark.createDataFrame([(e.__name__, e.exit_code, e().outcome, e.retryable, e.detail) for e in CATALOGUE], "kind string, exit_code int, outcome string, retryable boolean, detail string")
