"""Units to documents: decode, normalise line ends, convert, cleanse, compose the maps; one pass over the units in Arrow batches.

Converters are chosen by media type from a registry of named ones, so that a caller can add one or name another. A converter takes bytes
and gives text with a map, or refuses with one of the skip reasons.
"""

from __future__ import annotations

import codecs
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mosaica import dims
from mosaica.errors import ContractError, TraceError
from mosaica.functions.batches import slices
from mosaica.operators import kernels, pdf
from mosaica.operators.maps import SEGMENT, answered_in, traceable_in

_STATEFUL = ("iso2022_jp", "iso2022_jp_2", "iso2022_kr")
LEAST_CONFIDENCE = 0.3
TEXT_TYPES = frozenset(("text/markdown", "text/plain", "text/html", "application/xhtml+xml"))


@dataclass
class Converted:
    """Text, its map, and how the bytes were read."""

    text: str
    segments: list[kernels.Segment]
    source_length: int
    source_unit: str = "characters"
    encoding: str = "utf-8"
    bom: int = 0
    detected: bool = False


class Refused(Exception):
    """``reason`` is one of dims.SKIP_REASONS."""

    def __init__(self, reason: str, detail: str = ""):
        super().__init__(f"{reason}: {detail}")
        self.reason, self.detail = reason, detail


def decoded(data: bytes) -> tuple[str, str, int]:
    """text, encoding, bytes of the mark: UTF-8, UTF-16 with a mark, or a self-describing stateful encoding; else Refused."""
    try:
        if data.startswith(codecs.BOM_UTF8):
            return data[3:].decode(), "utf-8-sig", 3
        if data[:2] in (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE):
            return data.decode("utf-16"), "utf-16", 2
        text = data.decode()
    except UnicodeDecodeError as e:
        raise Refused("undecodable", f"byte {e.start} fits no encoding that says what it is") from e
    if "\0" in text:
        raise Refused("undecodable", f"a NUL at {text.index(chr(0))}: UTF-16 without its mark looks like this")
    if "\x1b" not in text:
        return text, "utf-8", 0
    for name in _STATEFUL:
        try:
            read = data.decode(name)
            if "\x1b" not in read and read.encode(name) == data:
                return read, name, 0
        except UnicodeError:
            continue
    raise Refused("undecodable", f"an escape character at {text.index(chr(27))}, in none of {', '.join(_STATEFUL)}")


def detected(data: bytes) -> tuple[str, str] | None:
    """Text and encoding by the optional detector, if it is there and sure enough."""
    try:
        from charset_normalizer import from_bytes
    except ImportError:
        return None
    best = from_bytes(data).best()
    return (str(best), best.encoding) if best is not None and 1 - best.chaos >= LEAST_CONFIDENCE else None


def _plain(text: str) -> tuple[str, list[kernels.Segment]]:
    return text, [kernels.Segment(0, len(text), 0, len(text), "verbatim")] if text else []


def textual(render: Callable[[str], tuple[str, list[kernels.Segment]]] = _plain, detect: bool = False) -> Callable[[bytes, str], Converted]:
    """A converter of text: decoding and line ends before ``render``, whose map is composed with theirs."""

    def convert(content: bytes, media_type: str) -> Converted:
        guessed = False
        try:
            text, encoding, bom = decoded(content)
        except Refused:
            found = detected(content) if detect and media_type in TEXT_TYPES else None
            if found is None:
                raise
            (text, encoding), bom, guessed = found, 0, True
        even, first = kernels.rewritten(text, kernels.endings(text))
        try:
            body, segments = render(even)
            whole = kernels.merged(kernels.composed(first, segments))
        except (AssertionError, ValueError, TraceError) as e:
            raise Refused("unparseable_html", str(e)) from e
        return Converted(body, whole, len(text), "characters", encoding, bom, guessed)

    return convert


def paged(order: str = "stream", gap: float = pdf.WORD_GAP) -> Callable[[bytes, str], Converted]:
    def convert(content: bytes, media_type: str) -> Converted:
        try:
            text, segments, pages = pdf.pdf_text(content, gap, order)
        except pdf.Refused as e:
            raise Refused(e.reason, e.detail) from e
        return Converted(text, segments, pages, "opaque", "")

    return convert


def external(extract: Callable[[str], str | None]) -> Callable[[bytes, str], Converted]:
    """A converter around any function from page to text: the map comes from aligning its lines with the page."""

    def convert(content: bytes, media_type: str) -> Converted:
        text, encoding, bom = decoded(content)
        even, first = kernels.rewritten(text, kernels.endings(text))
        try:
            body = extract(even)
        except Exception as e:
            raise Refused("unreadable", str(e)) from e
        if not body or not body.strip():
            raise Refused("no_main_content", "the extractor found nothing")
        later, _, _ = kernels.aligned(even, body)
        return Converted(body, kernels.merged(kernels.composed(first, later)), len(text), "characters", encoding, bom)

    return convert


def external_pages(read: Callable[[bytes], list[str | list[kernels.Placed]]], order: str | None = None) -> Callable[[bytes, str], Converted]:
    """A converter around any function from bytes to pages, each a text or placed strings that ``order`` puts in line."""

    def convert(content: bytes, media_type: str) -> Converted:
        try:
            pages = read(content)
        except Exception as e:
            raise Refused("unreadable", str(e)) from e
        parts, segments, at = [], [], 0
        for i, page in enumerate(pages):
            text = page if isinstance(page, str) else kernels.ordered_text(kernels.ORDERS[order or "rows"](page))
            if text.strip():
                text += "" if text.endswith("\n") else "\n"
                parts.append(text)
                segments.append(kernels.Segment(at, at + len(text), i, i + 1, "transformed", "pdf.page"))
                at += len(text)
        if not pages or not parts:
            raise Refused("no_text_layer" if pages else "no_pages", f"{len(pages)} pages")
        return Converted("".join(parts), segments, len(pages), "opaque", "")

    return convert


@dataclass
class Registry:
    """Named converters; ``claims`` says which is taken for a media type, others are offered by name only."""

    converters: dict[str, Callable[[bytes, str], Converted]] = field(default_factory=dict)
    claims: dict[str, str] = field(default_factory=dict)

    def register(self, name: str, converter: Callable[[bytes, str], Converted], *media_types: str) -> None:
        """Add a converter that claims media types; a name or claim that is taken is refused."""
        if name in self.converters or any(m in self.claims for m in media_types):
            raise ContractError(f"{name} or one of {media_types} is registered already")
        self.converters[name] = converter
        self.claims |= dict.fromkeys(media_types, name)

    def offer(self, name: str, converter: Callable[[bytes, str], Converted]) -> None:
        self.register(name, converter)

    def chosen(self, overrides: dict[str, str] | None = None) -> Registry:
        """The registry with other converters for some media types; unknown names are refused."""
        for name in (overrides or {}).values():
            if name not in self.converters:
                raise ContractError(f"no converter is called {name!r}; there are {', '.join(sorted(self.converters))}")
        return Registry(self.converters, self.claims | (overrides or {}))

    def media_types(self) -> list[str]:
        return sorted(self.claims)

    def name_for(self, media_type: Column) -> Column:
        """The converter's name as a column; null if nothing claims the media type. A literal map: no join."""
        pairs = [F.lit(x) for pair in sorted(self.claims.items()) for x in pair]
        return F.create_map(*pairs)[media_type] if pairs else F.lit(None).cast("string")


def standard(encoding: str = "strict", order: str = "stream", gap: float = pdf.WORD_GAP) -> Registry:
    """The built-in converters."""
    out, detect = Registry(), encoding == "detect"
    out.register("markdown@1", textual(detect=detect), "text/markdown")
    out.register("plaintext@1", textual(detect=detect), "text/plain")
    out.register("html@1", textual(kernels.html_text, detect), "text/html", "application/xhtml+xml")
    out.register("pdf_text@1" if order == "stream" else f"pdf_text@1+{order}", paged(order, gap), "application/pdf")
    out.offer("text@1", textual(detect=detect))
    return out


_REMOVAL = "struct<rule:string,kind:string,start:int,end:int,characters:int,hash:string>"
RESULT = f"struct<text:string,segments:array<{SEGMENT}>,removals:array<{_REMOVAL}>,source_length:int,source_unit:string,encoding:string,bom_bytes:int,encoding_detected:boolean,reason:string,detail:string>"


def _one(content: bytes, media_type: str, converter: Callable | None, pack: dims.Ruleset) -> dict:
    if converter is None:
        return {"reason": "no_converter", "detail": media_type}
    try:
        done = converter(content, media_type)
    except Refused as e:
        return {"reason": e.reason, "detail": e.detail}
    edits, taken = kernels.cleansing(done.text, pack)
    text, segments = done.text, done.segments
    if edits:
        text, later = kernels.rewritten(done.text, edits)
        segments = kernels.merged(kernels.composed(segments, later))
    return {
        "text": text, "segments": [s._asdict() for s in segments], "source_length": done.source_length, "source_unit": done.source_unit, "encoding": done.encoding, "bom_bytes": done.bom, "encoding_detected": done.detected,
        "removals": [{"rule": r, "kind": k, "start": a, "end": b, "characters": b - a, "hash": "sha256:" + hashlib.sha256(x.encode()).hexdigest()} for r, k, a, b, x in taken],
    }


def convert(units: DataFrame, registry: Registry | None = None, pack: dims.Ruleset = dims.CORE, content_col: str = "content", type_col: str = "media_type", into: str = "converted") -> DataFrame:
    """All input columns, ``converter`` (its name) and ``into``: struct of the cleansed text, its map to the source, removals, how the bytes were read; or reason and detail.

    A unit is worked on by itself: no shuffle. Null content counts as empty.
    """
    registry = registry or standard()
    rows = units.drop(into, "converter").withColumn("converter", registry.name_for(F.col(type_col)))
    names, at, kind_at = rows.columns, rows.columns.index(content_col), rows.columns.index(type_col)
    result = T.StructType([*rows.schema.fields, T.StructField(into, T._parse_datatype_string(RESULT))])
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(result).field(into).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(a, n) for batch in batches for a, n in slices(batch.column(at))):
            done = []
            for content, media_type, name in zip(part.column(at).to_pylist(), part.column(kind_at).to_pylist(), part.column(len(names) - 1).to_pylist(), strict=True):
                content = content.encode() if isinstance(content, str) else content or b""
                done.append(_one(content, media_type, registry.converters.get(name), pack))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(done, kind)], [*names, into])

    return rows.mapInArrow(run, result)


def documents(converted: DataFrame, column: str = "converted") -> DataFrame:
    """Converted units with the counts that a manifest has: characters, traceable_characters, answered_source_units."""
    c = F.col(column)
    ok = c["reason"].isNull()
    return converted.where(ok).select("*", F.length(c["text"]).cast("long").alias("characters"), traceable_in(c["segments"]).alias("traceable_characters"), answered_in(c["segments"]).alias("answered_source_units"))


def skips(converted: DataFrame, keys: list[str], column: str = "converted") -> DataFrame:
    """keys, reason, detail of the units that gave no document."""
    return converted.where(F.col(column)["reason"].isNotNull()).select(*keys, F.col(column)["reason"].alias("reason"), F.col(column)["detail"].alias("detail"))
