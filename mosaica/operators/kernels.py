"""State machines of the engine, on one text at a time: rewriting, map composition, alignment, HTML, reading order.

A map is a list of segments ``(out_start, out_end, src_start, src_end, kind, rule)`` that tile the output in order. Everything that is
regular is done with column functions and joins instead (``functions``, ``operators.maps``); these are for Arrow-batched workers.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable
from html.entities import html5
from html.parser import HTMLParser
from itertools import groupby
from operator import itemgetter
from typing import NamedTuple

from mosaica import dims
from mosaica.errors import TraceError


class Segment(NamedTuple):
    """A stretch of output and where it came from; rule is null for verbatim stretches only."""

    out_start: int
    out_end: int
    src_start: int
    src_end: int
    kind: str
    rule: str | None = None


Edit = tuple[int, int, str, str]  # start, end, text, rule


def rewritten(source: str, edits: Iterable[Edit]) -> tuple[str, list[Segment]]:
    """The text after the edits and its map. Edits that do nothing are dropped; those that overlap, or pass the end, are refused."""
    parts, segments, out, at = [], [], 0, 0

    def keep(to: int) -> None:
        nonlocal out, at
        if to > at:
            parts.append(source[at:to])
            segments.append(Segment(out, out + to - at, at, to, "verbatim"))
            out, at = out + to - at, to

    for start, end, text, rule in sorted((e for e in edits if e[1] > e[0] or e[2]), key=itemgetter(0, 1)):
        if not 0 <= start <= end <= len(source):
            raise ValueError(f"edit [{start}:{end}] is outside the text")
        if start < at:
            raise ValueError(f"edit [{start}:{end}] overlaps the one before")
        keep(start)
        kind = "removal" if not text else "synthetic" if start == end else "transformed"
        segments.append(Segment(out, out + len(text), start, end, kind, rule))
        parts.append(text)
        out, at = out + len(text), end
    keep(len(source))
    return "".join(parts), segments


def merged(segments: Iterable[Segment]) -> list[Segment]:
    """Neighbouring verbatim segments that continue each other on both sides become one."""
    done: list[Segment] = []
    for s in segments:
        p = done[-1] if done else None
        if p and p.kind == s.kind == "verbatim" and p.src_end == s.src_start and p.out_end == s.out_start:
            done[-1] = p._replace(out_end=s.out_end, src_end=s.src_end)
        else:
            done.append(s)
    return done


def located(segments: list[Segment], start: int, end: int) -> tuple[int, int] | None:
    """Hull of the sources of an output range: clipped in verbatim segments, whole in others. A point meets all it touches."""
    lows, highs = [], []
    for s in segments:
        hit = s.out_start <= start <= s.out_end if start == end else s.out_start < s.out_end and s.out_start < end and start < s.out_end
        if hit:
            exact, shift = s.kind == "verbatim", s.src_start - s.out_start
            lows.append(max(s.out_start, start) + shift if exact else s.src_start)
            highs.append(min(s.out_end, end) + shift if exact else s.src_end)
    return (min(lows), max(highs)) if lows else None


def composed(first: list[Segment], later: list[Segment]) -> list[Segment]:
    """One map for two stages: ``later`` was made from the output of ``first``. Linear but for the stretches that a segment spans."""
    ends = [s.out_end for s in first]
    width = ends[-1] if ends else 0
    if max((s.src_end for s in later), default=0) > width:
        raise TraceError("the later map starts from another text")
    result: list[Segment] = []
    spent: set[int] = set()  # segments without output go to the first stretch that meets them

    def near(start: int, end: int) -> Iterable[int]:
        i = bisect_left(ends, start)
        while i < len(first) and first[i].out_start <= end:
            yield i
            i += 1

    for s in later:
        if s.kind != "verbatim":
            hull = located([first[i] for i in near(s.src_start, s.src_end)], s.src_start, s.src_end) or (0, 0)
            result.append(Segment(s.out_start, s.out_end, *hull, s.kind, s.rule))
            continue
        shift, found = s.out_start - s.src_start, []
        for i in near(s.src_start, s.src_end):
            e = first[i]
            if e.out_start == e.out_end:
                if i not in spent and s.src_start <= e.out_start <= s.src_end:
                    spent.add(i)
                    found.append(e._replace(out_start=e.out_start + shift, out_end=e.out_end + shift))
                continue
            low, high = max(e.out_start, s.src_start), min(e.out_end, s.src_end)
            if low < high:
                move = e.src_start - e.out_start
                source = (low + move, high + move) if e.kind == "verbatim" else (e.src_start, e.src_end)
                found.append(Segment(low + shift, high + shift, *source, e.kind, e.rule))
        result += sorted(found, key=itemgetter(0, 1))
    return result


def checked(segments: list[Segment], length: int, unit: str = "characters") -> list[Segment]:
    """The map itself if it tiles the output; else TraceError."""
    at = 0
    for s in segments:
        if s.out_start != at or s.out_end < at or s.src_end < s.src_start:
            raise TraceError(f"the map has a gap, overlap or backward range at {at}")
        if (s.kind == "verbatim") != (s.rule is None) or s.kind == "removal" and s.out_start != s.out_end or s.kind not in dims.KINDS:
            raise TraceError(f"the map has an impossible {s.kind} segment at {at}")
        if s.kind == "verbatim" and unit == "characters" and s.out_end - s.out_start != s.src_end - s.src_start:
            raise TraceError(f"a verbatim segment at {at} differs in length")
        at = s.out_end
    if at != length:
        raise TraceError(f"the map ends at {at}, the text at {length}")
    return segments


def endings(text: str) -> list[Edit]:
    """Edits that make CRLF and lone CR a line feed."""
    out, at = [], text.find("\r")
    while at >= 0:
        end = at + 1 + (text[at + 1 : at + 2] == "\n")
        out.append((at, end, "\n", "line_ending"))
        at = text.find("\r", end)
    return out


# Cleansing


_STOP = frozenset(" \t\n\r\f\v<>\"'`|\\^{}")
_PAIRS = {")": "(", "]": "[", "}": "{"}


def urls(text: str) -> list[tuple[int, int]]:
    """Ranges of all URLs, without punctuation that belongs to the sentence around them."""
    found, at = [], 0
    while (start := text.find("http", at)) >= 0:
        if not text.startswith(("://", "s://"), start + 4):
            at = start + 1
            continue
        end = start
        while end < len(text) and text[end] not in _STOP:
            end += 1
        while end > start:
            last = text[end - 1]
            if last not in ".,;:!?" and (last not in _PAIRS or text.count(last, start, end - 1) < text.count(_PAIRS[last], start, end - 1)):
                break
            end -= 1
        if end > start:
            found.append((start, end))
        at = max(end, start + 1)
    return found


def cleansing(text: str, pack: dims.Ruleset = dims.CORE) -> tuple[list[Edit], list[tuple[str, str, int, int, str]]]:
    """Edits that take claimed parameters out of all URLs, and for each: rule, kind, start, end, what was taken."""
    edits, taken = [], []
    for start, end in urls(text) if pack.rules else ():
        mark = text.find("?", start, end)
        if mark < 0:
            continue
        stop = text.find("#", mark, end)
        stop = end if stop < 0 else stop
        kept, gone, at = [], [], mark + 1
        for part in text[mark + 1 : stop].split("&"):
            name = part.partition("=")[0]
            rule = pack.matching(name) if name else None
            if rule:
                gone.append((rule.id, rule.kind, at, at + len(part), part))
            else:
                kept.append(part)
            at += len(part) + 1
        if gone:
            edits.append((mark, stop, "?" + "&".join(kept) if kept else "", "url_query"))
            taken += gone
    return edits, taken


# Alignment


def aligned(source: str, output: str, shortest: int = 12, window: int = 1 << 16) -> tuple[list[Segment], int, int]:
    """A map from the lines of ``output`` that stand in ``source``, searched forward only; and how many were found and not.

    A line is found where it begins at most ``window`` after the last one. Its own length, and lines before it that aren't looked for (with line
    ends of two characters), don't count; so the lines of a text are all found in it, however long they are.
    """
    segments: list[Segment] = []
    out = src = hits = misses = at = idle = 0

    def between(to_out: int, to_src: int) -> None:
        if out == to_out:
            if src < to_src:
                segments.append(Segment(out, out, src, to_src, "removal", "align.dropped"))
        elif src == to_src:
            segments.append(Segment(out, to_out, src, src, "synthetic", "align.inserted"))
        elif output[out:to_out].strip():
            segments.append(Segment(out, to_out, src, to_src, "transformed", "align.gap"))
        else:
            segments.append(Segment(out, out, src, to_src, "removal", "align.dropped"))
            segments.append(Segment(out, to_out, to_src, to_src, "synthetic", "align.separator"))

    for line in output.split("\n"):
        begin, at = at, at + len(line) + 1
        if len(line) < shortest or not line.strip():
            idle += len(line) + 1
            continue
        place = source.find(line, src, src + window + 2 * idle + len(line))
        idle = 0
        if place < 0:
            misses += 1
            continue
        between(begin, place)
        out, src = begin + len(line), place + len(line)
        segments.append(Segment(begin, out, place, src, "verbatim"))
        hits += 1
    between(len(output), len(source))
    return segments, hits, misses


# HTML


class _Events(HTMLParser):
    """Start offset, kind and payload of each construct; a construct runs to the start of the next."""

    def __init__(self, text: str):
        super().__init__(convert_charrefs=False)
        self.found: list[tuple[int, str, str]] = []
        self.starts = [0]
        for line in text.split("\n"):
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.feed(text)
        self.close()

    def _add(self, kind: str, payload: str = "") -> None:
        line, column = self.getpos()
        self.found.append((self.starts[line - 1] + column, kind, payload))

    def handle_starttag(self, tag, attrs):
        self._add("open", tag)

    def handle_startendtag(self, tag, attrs):
        self._add("open", tag)
        self._add("shut", tag)

    def handle_endtag(self, tag):
        self._add("shut", tag)

    def handle_data(self, data):
        self._add("data", data)

    def handle_entityref(self, name):
        self._add("name", name)

    def handle_charref(self, name):
        self._add("number", name)

    def handle_comment(self, data):
        self._add("other")

    handle_decl = handle_pi = unknown_decl = handle_comment


def _character(kind: str, payload: str, written: str) -> str:
    if kind == "name":
        return html5.get(payload + ";") or html5.get(payload) or written
    try:
        point = int(payload[1:], 16) if payload[:1] in ("x", "X") else int(payload)
        return written if 0xD800 <= point < 0xE000 else chr(point)
    except (ValueError, OverflowError):
        return written


def html_text(page: str) -> tuple[str, list[Segment]]:
    """A page (line ends normalised) as text with breaks and heading marks, and its map.

    Text inside ``dims.BOILERPLATE`` elements goes; an element left open keeps all after it out. White space between blocks goes, and
    becomes one space inside them. References to nothing stay as written. Lines are counted by line feeds only.
    """
    parts: list[str] = []
    segments: list[Segment] = []
    silent: list[str] = []
    length, fresh = 0, True

    def put(text: str, start: int, end: int, kind: str, rule: str | None) -> None:
        nonlocal length
        last = segments[-1] if segments else None
        if kind == "removal" and last and last.kind == "removal" and last.rule == rule and last.src_end == start:
            segments[-1] = last._replace(src_end=end)
            return
        parts.append(text)
        segments.append(Segment(length, length + len(text), start, end, kind, rule))
        length += len(text)

    events = _Events(page).found
    for i, (start, kind, payload) in enumerate(events):
        end = events[i + 1][0] if i + 1 < len(events) else len(page)
        if kind in ("open", "shut"):
            if kind == "open" and payload in dims.BOILERPLATE:
                silent.append(payload)
            elif kind == "shut" and silent and silent[-1] == payload:
                silent.pop()
            put("", start, end, "removal", "markup.tag." + payload)
            if not silent and kind == "open" and payload in dims.HEADINGS:
                put(dims.HEADINGS[payload], end, end, "synthetic", "structure." + payload)
            if not silent and kind == "shut" and payload in dims.BLOCKS:
                put("\n\n", end, end, "synthetic", "structure." + payload)
                fresh = True
        elif kind == "other":
            put("", start, end, "removal", "markup.dropped")
        elif silent:
            put("", start, end, "removal", "boilerplate." + silent[-1])
        elif kind != "data":
            put(_character(kind, payload, page[start:end]), start, end, "transformed", "entity.reference")
        elif payload.strip():
            put(payload, start, end, "verbatim", None)
            fresh = False
        elif fresh:
            put("", start, end, "removal", "whitespace.between-elements")
        elif payload == " ":
            put(payload, start, end, "verbatim", None)
        else:
            put(" ", start, end, "transformed", "whitespace.collapsed")
    return "".join(parts), segments


# Reading order


class Placed(NamedTuple):
    """A stretch of text at its place on a page; y counts upwards."""

    text: str
    x: float
    y: float


def floors(values: Iterable[float], apart: float) -> list[float]:
    """Least values of the clusters: a value more than ``apart`` over the last floor starts a new one."""
    out: list[float] = []
    for v in sorted(set(values)):
        if not out or v - out[-1] > apart:
            out.append(v)
    return out


def _floor(value: float, known: list[float]) -> float:
    i = bisect_left(known, value)
    return known[i] if i < len(known) and known[i] == value else known[max(0, i - 1)]


def in_rows(runs: list[Placed], tolerance: float = 4.0) -> list[list[Placed]]:
    """Lines down the page, each from left to right."""
    base = floors((r.y for r in runs), tolerance)
    key = lambda r: -_floor(r.y, base)
    return [list(g) for _, g in groupby(sorted(runs, key=lambda r: (key(r), r.x)), key)]


def in_columns(runs: list[Placed], gap: float = 24.0, tolerance: float = 4.0) -> list[list[Placed]]:
    """Lines of each column down the page, columns from left to right."""
    sides, base = floors((r.x for r in runs), gap), floors((r.y for r in runs), tolerance)
    key = lambda r: (_floor(r.x, sides), -_floor(r.y, base))
    return [list(g) for _, g in groupby(sorted(runs, key=lambda r: (*key(r), r.x)), key)]


ORDERS: dict[str, Callable[[list[Placed]], list[list[Placed]]]] = {"rows": in_rows, "columns": in_columns}


def ordered_text(lines: list[list[Placed]]) -> str:
    return "\n".join(" ".join(r.text for r in line) for line in lines)
