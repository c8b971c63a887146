"""Credential screening: known formats, an optional entropy tier, and the gate that stops a run.

A native test picks out the few rows that can have a finding; only those reach the kernel that gives exact ranges.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaica import dims
from mosaica.functions import batches

SHORTEST, HEX_BITS, WIDE_BITS = 20, 3.0, 4.5
_FOUND = "array<struct<rule:string,label:string,start:int,end:int,characters:int,hash:string>>"


def pattern(s: dims.Signature) -> str:
    """A prefix that no character of the body's alphabet stands before, and the longest run after it. Fit for Java and Python; it can't backtrack."""
    body = f"[{s.alphabet}]{{{s.minimum},}}" if s.minimum else f"[{s.alphabet}]*"
    return f"(?<![{s.alphabet}]){re.escape(s.prefix)}{body}"


def entropy(text: str) -> float:
    """Bits a character; 0 for an empty string."""
    n = len(text)
    return -sum(k / n * math.log2(k / n) for k in Counter(text).values()) if n else 0.0


def _ranges(text: str, tiers: tuple[str, ...]) -> list[tuple[str, str, int, int]]:
    out = []
    if "signatures" in tiers:
        for s in dims.SIGNATURES:
            if s.prefix in text:
                out += [(s.id, s.label, *m.span()) for m in re.finditer(pattern(s), text)]
    if "entropy" in tiers:
        hexes = {m.span() for m in re.finditer(rf"[0-9a-fA-F]{{{SHORTEST},}}", text) if entropy(m[0]) >= HEX_BITS}
        out += [("entropy.hex", "a high-entropy hex run", *s) for s in hexes]
        wide = (m for m in re.finditer(rf"[0-9A-Za-z_\-]{{{SHORTEST},}}", text) if m.span() not in hexes)
        out += [("entropy.base64", "a high-entropy run", *m.span()) for m in wide if entropy(m[0]) >= WIDE_BITS]
    return sorted(out, key=lambda f: (f[2], f[3], f[0]))


def suspicious(text: Column, tiers: tuple[str, ...] = ("signatures",)) -> Column:
    """Whether a text can have a finding; no text with one is missed."""
    tests = []
    if "signatures" in tiers:
        tests += [text.contains(s.prefix) for s in dims.SIGNATURES]
    if "entropy" in tiers:
        tests.append(text.rlike(rf"[0-9A-Za-z_\-]{{{SHORTEST}}}"))
    hit = tests[0]
    for t in tests[1:]:
        hit = hit | t
    return F.coalesce(hit, F.lit(False))


def found(text: Column, tiers: tuple[str, ...] = ("signatures",)) -> Column:
    """Array of findings of a text, by start, end and rule; empty for null."""

    def screen(t):
        if t is None:
            return None
        return [{"rule": r, "label": n, "start": a, "end": b, "characters": b - a, "hash": "sha256:" + hashlib.sha256(t[a:b].encode()).hexdigest()} for r, n, a, b in _ranges(t, tiers)]

    return F.coalesce(batches.kernel(screen, _FOUND)(F.when(suspicious(text, tiers), text)), F.array().cast(_FOUND))


def findings(df: DataFrame, keys: list[str], text_col: str, tiers: tuple[str, ...] = ("signatures",)) -> DataFrame:
    """keys, rule, label, start, end, characters, hash: one row a finding; never the value."""
    rows = df.where(suspicious(F.col(text_col), tiers)).select(*keys, F.explode(found(F.col(text_col), tiers)).alias("f"))
    return rows.select(*keys, "f.*")


def gate(findings: DataFrame, allowed: DataFrame, key: str = "unit_key") -> DataFrame:
    """Findings that nobody has allowed; ``allowed`` has rule and the key. Any row of it stops a run."""
    return findings.join(allowed.select("rule", key).distinct(), ["rule", key], "left_anti")
