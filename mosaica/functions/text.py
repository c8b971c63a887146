"""Column functions over text and bytes: hashes, keys, decoding, line ends, front matter, titles. No Python workers, but for NFC of other than ASCII."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH = "^sha256:[0-9a-f]{64}$"
_PAD = r"[ \t\x0b\f\r]*"
#: A block that opens on the first line and is closed later on; no repeated group, so long texts need no deep stack.
BLOCK = rf"(?s)\A{_PAD}---{_PAD}\n(?:.*?\n)??{_PAD}(?:---|\.\.\.){_PAD}(?=\n|\z)"
PRODUCER = "mosaica.sync/1"
LAYERS = ("fact", "measure")


def content_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def is_hash(text: Column) -> Column:
    return F.coalesce(text.rlike(HASH), F.lit(False))


def canonical(value: object) -> str:
    """JSON with keys in the order of UTF-16 units, no spaces, and no floats: one form for one value."""

    def check(x: object) -> object:
        if isinstance(x, float):
            raise TypeError("a float has no canonical form here")
        if isinstance(x, dict):
            return {k: check(x[k]) for k in sorted(x, key=lambda k: k.encode("utf-16-be", "surrogatepass"))}
        if isinstance(x, (list, tuple)):
            return [check(v) for v in x]
        if x is None or isinstance(x, (str, bool, int)):
            return x
        raise TypeError(f"{type(x).__name__} has no canonical form")

    return json.dumps(check(value), ensure_ascii=False, separators=(",", ":"))


def hash_of(value: object) -> str:
    import hashlib

    return "sha256:" + hashlib.sha256(canonical(value).encode()).hexdigest()


def canonical_column(**fields: Column) -> Column:
    """Canonical JSON of a flat record of strings and whole numbers. Texts with control characters need ``canonical``: the case of their escapes differs."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def key_refusal(parts: Column) -> Column:
    """Why an array of names can't be a key; null if it can: no_parts, empty_part, climbs, separator."""
    return (
        F.when(F.size(parts) == 0, "no_parts").when(F.exists(parts, lambda p: p == ""), "empty_part").when(F.exists(parts, lambda p: p.isin(".", "..")), "climbs")
        .when(F.exists(parts, lambda p: p.contains("/") | p.contains("\\")), "separator")
    )


def unit_key(parts: Column) -> Column:
    """The parts in normal form C, joined by /; null where refused. ASCII keys never leave the JVM."""
    joined = F.array_join(parts, "/")
    return F.when(key_refusal(parts).isNull(), F.when(joined.rlike(r"^[\x00-\x7f]*$"), joined).otherwise(nfc(joined)))


def nfc(text: Column) -> Column:
    import unicodedata

    @F.udf("string", useArrow=True)
    def form(t):
        return None if t is None else unicodedata.normalize("NFC", t)

    return form(text)


def normalized(text: Column) -> Column:
    """CRLF and lone CR as LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def peeked(content: Column) -> Column:
    """Bytes as text with U+FFFD for what isn't UTF-8: for screening before any conversion."""
    return F.make_valid_utf8(content.cast("string"))


def is_strict_utf8(content: Column) -> Column:
    """UTF-8 without NUL."""
    return F.is_valid_utf8(content.cast("string")) & ~content.cast("string").contains("\x00")


def block(text: Column) -> Column:
    """The front-matter block with its fences; null if there is none."""
    found = F.regexp_extract(text, BLOCK, 0)
    return F.when(found != "", found)


def stated_keys(block_text: Column) -> Column:
    """Keys that a block states, in order, each once."""
    lines = F.split(block_text, "\n")
    keys = F.transform(F.filter(lines, lambda x: x.contains(":")), lambda x: F.btrim(F.substring_index(x, ":", 1), F.lit(" \t\x0b\f\r")))
    return F.array_distinct(F.filter(keys, lambda k: (k != "") & ~k.startswith("-") & ~k.isin("---", "...")))


def unquoted(value: Column) -> Column:
    quoted = (F.length(value) >= 2) & F.left(value, F.lit(1)).isin("'", '"') & (F.left(value, F.lit(1)) == F.right(value, F.lit(1)))
    return F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)


def title(text: Column) -> Column:
    """The block's title (which may be empty), else the first heading outside it, else null."""
    own = block(text)
    stated = r"(?m)^[ \t]*title[ \t]*:[ \t]*(.*?)[ \t]*$"
    body = F.substring(text, F.coalesce(F.length(own), F.lit(0)) + 1, F.length(text))
    heading = r"(?m)^#{1,6}[ \t]+(\S.*?)[ \t]*$"
    return F.when(own.rlike(stated), unquoted(F.regexp_extract(own, stated, 1))).when(body.rlike(heading), F.regexp_extract(body, heading, 1))


def is_bare(value: Column) -> Column:
    """Fit for one line of a block: neither blank, padded nor broken."""
    return (value != "") & (F.btrim(value, F.lit(" \t\n\r\x0b\f")) == value) & ~value.rlike("[\r\n]")


def is_fact_key(key: Column) -> Column:
    return is_bare(key) & ~key.contains(":") & ~key.isin("layer", "producer")


def matter(facts: Column | None = None, layer: str = "fact") -> Column:
    """Lines that the engine states: layer, producer, and the facts (array of key, value)."""
    if layer not in LAYERS:
        raise ValueError(f"the engine states {' or '.join(LAYERS)}, never {layer!r}")
    lines = F.array(F.lit(f"layer: {layer}"), F.lit(f"producer: {PRODUCER}"))
    return lines if facts is None else F.concat(lines, F.transform(F.coalesce(facts, F.array().cast("array<struct<key:string,value:string>>")), lambda f: F.concat(f.key, F.lit(": "), f.value)))


def insertion(text: Column, lines: Column) -> Column:
    """struct of at, inserted: a whole block before the text, or the lines that its own block lacks, after the first line; empty if none."""
    own = block(text)
    have = F.coalesce(stated_keys(own), F.array().cast("array<string>"))
    missing = F.filter(lines, lambda x: ~F.array_contains(have, F.substring_index(x, ":", 1)))
    whole = F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n"))
    part = F.when(F.size(missing) > 0, F.concat(F.array_join(missing, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    return F.struct(F.when(own.isNull(), 0).otherwise(F.locate("\n", text)).cast("int").alias("at"), F.when(own.isNull(), whole).otherwise(part).alias("inserted"))


def inserted(text: Column, at: Column, piece: Column) -> Column:
    return F.concat(F.substring(text, F.lit(1), at), piece, F.substring(text, at + 1, F.length(text)))


def shifted(segments: Column, at: Column, piece: Column) -> Column:
    """A map after an insertion: a synthetic segment at ``at``, later ones moved, a verbatim one across it cut."""
    n = F.length(piece)

    def move(s: Column, low: Column, high: Column, by: Column) -> Column:
        exact = s.kind == "verbatim"
        return F.struct(
            (low + by).cast("int").alias("out_start"), (high + by).cast("int").alias("out_end"), F.when(exact, s.src_start + low - s.out_start).otherwise(s.src_start).cast("int").alias("src_start"),
            F.when(exact, s.src_end - (s.out_end - high)).otherwise(s.src_end).cast("int").alias("src_end"), s.kind.alias("kind"), s.rule.alias("rule"),
        )

    before = F.transform(F.filter(segments, lambda s: (s.out_start < at) | ((s.out_start == at) & (s.out_end == at) & (at > 0))), lambda s: move(s, s.out_start, F.least(s.out_end, at), F.lit(0)))
    after = F.transform(F.filter(segments, lambda s: (s.out_end > at) | ((s.out_start == at) & (s.out_end == at) & (at == 0))), lambda s: move(s, F.greatest(s.out_start, at), s.out_end, n))
    source = F.coalesce(F.try_element_at(before, F.lit(-1))["src_end"], F.lit(0))
    own = F.array(F.struct(at.cast("int").alias("out_start"), (at + n).cast("int").alias("out_end"), source.cast("int").alias("src_start"), source.cast("int").alias("src_end"), F.lit("synthetic").alias("kind"), F.lit("front_matter").alias("rule")))
    return F.when(n == 0, segments).otherwise(F.concat(before, own, after))


def byte_offset(text: Column, offset: Column, mark: Column) -> Column:
    """Bytes of UTF-8 before a character, the byte-order mark included."""
    return F.octet_length(F.substring(text, F.lit(1), offset)) + mark


def abbreviated(identity: Column) -> Column:
    """Twelve characters of a hash, without its algorithm."""
    return F.substring(F.substring_index(identity, ":", -1), 1, 12)
