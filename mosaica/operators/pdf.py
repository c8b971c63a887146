"""Text of PDF files with a map that answers with pages: objects by scan, Flate streams, simple fonts. No reader of fonts or of the page tree."""

from __future__ import annotations

import re
import zlib

from mosaica.operators.kernels import ORDERS, Placed, Segment, ordered_text

MOST_STREAM = 64 << 20
WORD_GAP = -180.0

_NUMBER = rb"-?[\d.]+"
_TEXT = rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)"
_HEX = rb"<[\s0-9a-fA-F]*>"
_OBJECTS = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.DOTALL)
_BODY = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.DOTALL)
_IS_PAGE = re.compile(rb"/Type\s*/Page(?![A-Za-z])")
_IS_COMPOSITE = re.compile(rb"/Subtype\s*/Type0(?![A-Za-z])")
_POINTS_TO = re.compile(rb"/Contents\s*(\d+\s+\d+\s+R|\[[^\]]*\])")
_SHOWN = re.compile(rb"(?P<list>\[(?:\\.|[^\[\]])*\])\s*TJ|(?P<one>" + _TEXT + rb"|" + _HEX + rb")\s*(?:Tj|'|\")", re.DOTALL)
_MOVED = re.compile(rb"\bBT\b|(?:" + _NUMBER + rb"\s+){4}(?P<x>" + _NUMBER + rb")\s+(?P<y>" + _NUMBER + rb")\s+Tm\b|(?P<dx>" + _NUMBER + rb")\s+(?P<dy>" + _NUMBER + rb")\s+T[dD]\b|(?P<lead>" + _NUMBER + rb")\s+TL\b|\bT\*")
_LINE = re.compile(rb"['\"]|\bT(?:\*|D|d|L|m)\b|\bT\*")
_IN_LIST = re.compile(rb"\((?:[^()\\]|\\.)*\)|" + _HEX + rb"|-?\d+(?:\.\d+)?")

_ESCAPED = dict(zip(b"nrtbf()\\", "\n\r\t\b\f()\\", strict=True))
_ODD = dict(zip(range(0x18, 0x20), "˘ˇˆ˙˝˛˚˜", strict=True)) | dict(zip(range(0x80, 0x9F), "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž", strict=True)) | {0xA0: "€"}


class Refused(Exception):
    """Why a file gives no text: ``reason`` is one of the skip reasons."""

    def __init__(self, reason: str, detail: str):
        super().__init__(detail)
        self.reason, self.detail = reason, detail


def _inflated(raw: bytes, header: bytes) -> bytes:
    if b"/FlateDecode" not in header:
        return raw
    for bits in (15, -15):
        try:
            out = zlib.decompressobj(bits).decompress(raw, MOST_STREAM + 1)
        except zlib.error:
            continue
        if len(out) > MOST_STREAM:
            raise Refused("stream_too_large", f"a content stream inflates past {MOST_STREAM} bytes")
        return out
    return b""


def page_streams(content: bytes) -> list[bytes]:
    """The content of each page object, in the order of object numbers; the last definition of an object counts."""
    objects = {int(n): body for n, body in _OBJECTS.findall(content)}
    out = []
    for _, page in sorted(objects.items()):
        if not _IS_PAGE.search(page):
            continue
        m, found = _POINTS_TO.search(page), []
        for n in re.findall(rb"(\d+)\s+\d+\s+R", m[1]) if m else ():
            body = objects.get(int(n), b"")
            stream = _BODY.search(body)
            if stream:
                found.append(_inflated(stream[1], body))
        out.append(b"\n".join(found))
    return out


def _string(token: bytes) -> str:
    """A string operand in either form."""
    if token[:1] == b"<":
        digits = b"".join(token[1:-1].split())
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if raw.startswith(b"\xfe\xff"):
            return raw[2:].decode("utf-16-be", "replace")
        return raw.decode("latin-1").translate(_ODD)

    def one(m: re.Match) -> str:
        x = m[1]
        if x[:1] in b"01234567" and x:
            return chr(int(x, 8) & 255)
        return "" if x in (b"", b"\n", b"\r") else _ESCAPED.get(x[0], chr(x[0]))

    out, at = [], 1
    for m in re.finditer(rb"\\([0-7]{1,3}|.|\Z)", token[1:-1], re.DOTALL):
        out.append(token[at : m.start() + 1].decode("latin-1"))
        out.append(one(m))
        at = m.end() + 1
    out.append(token[at:-1].decode("latin-1"))
    return "".join(out).translate(_ODD)


def _shown(m: re.Match, gap: float) -> str:
    if m["one"]:
        return _string(m["one"])
    out: list[str] = []
    for token in _IN_LIST.findall(m["list"]):
        if token[:1] in (b"(", b"<"):
            out.append(_string(token))
        elif float(token) <= gap and out and not out[-1].endswith(" "):
            out.append(" ")
    return "".join(out)


def in_stream_order(stream: bytes, gap: float = WORD_GAP) -> str:
    """A page's text as its stream shows it; a line ends where a placing operator stands in the 40 bytes before."""
    out: list[str] = []
    for m in _SHOWN.finditer(stream):
        if out and _LINE.search(stream[max(0, m.start() - 40) : m.start()]):
            out.append("\n")
        out.append(_shown(m, gap))
    return "".join(out).strip()


def placed(stream: bytes, gap: float = WORD_GAP) -> list[Placed]:
    """A page's strings at the starts of their lines."""
    x = y = lead = 0.0
    out = []
    events = sorted([(m.start(), 0, m) for m in _MOVED.finditer(stream)] + [(m.start(), 1, m) for m in _SHOWN.finditer(stream)], key=lambda e: e[:2])
    for _, shows, m in events:
        if shows:
            if m[0][-1:] in b"'\"":
                y -= lead
            text = _shown(m, gap).strip()
            if text:
                out.append(Placed(text, x, y))
        elif m["x"]:
            x, y = float(m["x"]), float(m["y"])
        elif m["dx"]:
            x, y = x + float(m["dx"]), y + float(m["dy"])
            lead = -float(m["dy"]) if m[0].endswith(b"TD") else lead
        elif m["lead"]:
            lead = float(m["lead"])
        elif m[0] == b"BT":
            x = y = 0.0
        else:
            y -= lead
    return out


def pdf_text(content: bytes, gap: float = WORD_GAP, order: str = "stream") -> tuple[str, list[Segment], int]:
    """Text, map over pages, and number of pages; or Refused."""
    if content[:5] != b"%PDF-":
        raise Refused("not_a_pdf", "the file doesn't begin as a PDF does")
    streams = page_streams(content)
    if not streams:
        raise Refused("no_pages", "no page objects were found")
    if _IS_COMPOSITE.search(content):
        raise Refused("composite_font", "the text is set in a composite font, whose bytes are no characters")
    parts, segments, at = [], [], 0
    for i, stream in enumerate(streams):
        text = in_stream_order(stream, gap) if order == "stream" else ordered_text(ORDERS[order](placed(stream, gap)))
        if text:
            text += "" if text.endswith("\n") else "\n"
            parts.append(text)
            segments.append(Segment(at, at + len(text), i, i + 1, "transformed", "pdf.page"))
            at += len(text)
    if not parts:
        raise Refused("no_text_layer", f"{len(streams)} pages, none with text")
    return "".join(parts), segments, len(streams)
