"""Rewriting, maps, cleansing, alignment, HTML and PDF: properties on generated cases, and known answers."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mosaica import dims
from mosaica.errors import TraceError
from mosaica.operators import kernels as K
from mosaica.operators import pdf

quick = settings(max_examples=150, deadline=None)


@st.composite
def edited(draw):
    text = draw(st.text("ab\r\n?é😀", max_size=40))
    cuts = sorted(draw(st.lists(st.integers(0, len(text)), max_size=6, unique=True)))
    return text, [(a, b, draw(st.text("xy", max_size=3)), "r") for a, b in zip(cuts[::2], cuts[1::2], strict=False)]


@quick
@given(edited())
def test_rewriting_tiles_both_sides(case):
    text, edits = case
    out, segments = K.rewritten(text, edits)
    K.checked(segments, len(out))
    assert sum(s.src_end - s.src_start for s in segments) == len(text)
    assert all(out[s.out_start : s.out_end] == text[s.src_start : s.src_end] for s in segments if s.kind == "verbatim")
    assert K.merged(K.merged(segments)) == K.merged(segments)


def _plain_compose(first, later):
    """Composition by its definition, in the square of the segments."""
    out, spent = [], set()
    for s in later:
        if s.kind != "verbatim":
            out.append(K.Segment(s.out_start, s.out_end, *(K.located(first, s.src_start, s.src_end) or (0, 0)), s.kind, s.rule))
            continue
        own = []
        for i, e in enumerate(first):
            d = s.out_start - s.src_start
            if e.out_start == e.out_end:
                if i not in spent and s.src_start <= e.out_start <= s.src_end:
                    spent.add(i)
                    own.append(e._replace(out_start=e.out_start + d, out_end=e.out_end + d))
            elif max(e.out_start, s.src_start) < min(e.out_end, s.src_end):
                a, b = max(e.out_start, s.src_start), min(e.out_end, s.src_end)
                src = (a + e.src_start - e.out_start, b + e.src_start - e.out_start) if e.kind == "verbatim" else (e.src_start, e.src_end)
                own.append(K.Segment(a + d, b + d, *src, e.kind, e.rule))
        out += sorted(own, key=lambda x: x[:2])
    return out


@quick
@given(edited(), st.data())
def test_two_stages_compose_to_one_map(case, data):
    text, edits = case
    middle, first = K.rewritten(text, edits)
    cuts = sorted(data.draw(st.lists(st.integers(0, len(middle)), max_size=4, unique=True)))
    out, later = K.rewritten(middle, [(a, b, "z" * (b % 3), "s") for a, b in zip(cuts[::2], cuts[1::2], strict=False)])
    whole = K.composed(first, later)
    K.checked(whole, len(out))
    assert whole == _plain_compose(first, later)
    assert all(out[s.out_start : s.out_end] == text[s.src_start : s.src_end] for s in whole if s.kind == "verbatim")


def test_edits_that_overlap_or_leave_the_text_are_refused():
    for edits in ([(0, 2, "", "r"), (1, 3, "", "r")], [(2, 9, "", "r")]):
        with pytest.raises(ValueError, match="edit"):
            K.rewritten("abcd", edits)
    with pytest.raises(TraceError):
        K.composed(K.rewritten("ab", [])[1], K.rewritten("abc", [])[1])


@pytest.mark.parametrize("broken", [[K.Segment(1, 2, 0, 1, "verbatim")], [K.Segment(0, 2, 0, 1, "verbatim")], [K.Segment(0, 2, 3, 1, "transformed", "r")], [K.Segment(0, 2, 0, 2, "verbatim", "r")], [K.Segment(0, 2, 0, 2, "removal", "r")], []])
def test_maps_that_cannot_be_are_refused(broken):
    with pytest.raises(TraceError):
        K.checked(broken, 2)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("see https://e.test/a, and", ["https://e.test/a"]), ("(http://e.test/x_(y)).", ["http://e.test/x_(y)"]), ("<https://e.test>", ["https://e.test"]), ("http://", ["http"]), ("HTTPS://E.TEST httpx://", []),
        ("a http://b.test?q=1#f; http://c.test", ["http://b.test?q=1#f", "http://c.test"]), ("https://a.test]]", ["https://a.test"]),
    ],
)
def test_addresses_in_texts(text, want):
    found = [text[a:b] for a, b in K.urls(text)]
    assert [x.rstrip("/:") if x.startswith("http:") and len(x) < 8 else x for x in found] == want


@pytest.mark.parametrize(
    ("url", "want", "rules"),
    [
        ("https://e.test/?utm_source=a&id=1", "https://e.test/?id=1", ["tracking.utm-family"]), ("https://e.test/?fbclid=1#f", "https://e.test/#f", ["tracking.fbclid"]), ("https://e.test/?id=1&&", "https://e.test/?id=1&&", []),
        ("https://e.test/?utm=&ref_=2&x", "https://e.test/?x", ["tracking.utm", "referral.ref-underscore"]), ("https://e.test/#a?utm_x=1", "https://e.test/#a", ["tracking.utm-family"]),
    ],
)
def test_cleansing(url, want, rules):
    edits, taken = K.cleansing(f"x {url} y")
    assert K.rewritten(f"x {url} y", edits)[0] == f"x {want} y"
    assert [t[0] for t in taken] == rules


def test_packs():
    assert len(dims.CORE.rules) == 65 and len(dims.SIGNATURES) == 21 and len(dims.SKIP_REASONS) == 22
    assert dims.CORE.matching("utm_x").id == "tracking.utm-family" and dims.CORE.matching("id") is None
    with pytest.raises(ValueError, match="twice"):
        dims.Ruleset("x", "1", (dims.CORE.rules[0], dims.CORE.rules[0]))


def test_alignment_known_answer():
    source = "<p>The first long line.</p><nav>menu</nav><p>A second line here.</p>"
    segments, hits, misses = K.aligned(source, "The first long line.\nA second line here.\nnot in the source at all")
    K.checked(segments, len("The first long line.\nA second line here.\nnot in the source at all"))
    assert (hits, misses) == (2, 1)
    assert [s.rule for s in segments] == ["align.dropped", None, "align.dropped", "align.separator", None, "align.gap"]


def test_alignment_finds_long_lines_and_lines_behind_many_short_ones():
    text = "\n".join(["w" * 70_000, "x" * 200_000, *["short"] * 30_000, "the line behind them", "", "a" * 12])
    for end in ("\n", "\r\n", "\r"):
        segments, hits, misses = K.aligned(text.replace("\n", end), text)
        K.checked(segments, len(text))
        assert (hits, misses) == (4, 0)
    assert K.aligned("." * 99 + "a line of text", "a line of text", window=98)[1:] == (0, 1)


PAGE = """<!DOCTYPE html><html><head><title>T</title></head><body><nav><a href="/">Home</a></nav>
<article><h2>Head</h2><p>One &amp; <b>two</b>&nbsp;&#x41; &unknown; <a href=x>a</a> <i>b</i></p><br><br/><!-- no --><p>Last</article><footer>f</footer><form>rest<p>lost"""


def test_html_known_answer():
    out, segments = K.html_text(PAGE)
    K.checked(segments, len(out))
    assert out == "## Head\n\nOne & two\xa0A &unknown; a b\n\n\n\nLast\n\n"
    assert sum(s.src_end - s.src_start for s in segments) == len(PAGE)
    rules = {s.rule for s in segments if s.kind == "removal"}
    assert {"boilerplate.head", "boilerplate.nav", "boilerplate.footer", "boilerplate.form", "markup.dropped", "whitespace.between-elements"} <= rules


@quick
@given(st.lists(st.sampled_from(["<p>", "</p>", "<nav>", "</nav>", "a b", " ", "\n\n", "&amp;", "&#65;", "&am", "<br/>", "<h1>", "</h1>", "<!-- x -->", "<", "\x0c", "é"]), max_size=25).map("".join))
def test_any_page_gives_a_whole_map(page):
    out, segments = K.html_text(page)
    K.checked(segments, len(out))
    assert sum(s.src_end - s.src_start for s in segments) == len(page)


def _pdf(*streams: bytes, extra: bytes = b"") -> bytes:
    out = b"%PDF-1.4\n" + extra
    for i, s in enumerate(streams):
        out += b"%d 0 obj << /Type /Page /Contents %d 0 R >> endobj\n%d 0 obj << >>\nstream\n%s\nendstream\nendobj\n" % (2 * i + 1, 2 * i + 2, 2 * i + 2, s)
    return out


def test_pdf_pages_and_refusals():
    text, segments, pages = pdf.pdf_text(_pdf(b"BT (a\\(b\\)) Tj T* [(c) -200 (d) 10 (e)] TJ ET", b"", b"BT <FEFF0041> Tj (\\101\\n) Tj ET"))
    assert (text, pages) == ("a(b)\nc de\nAA\n", 3) and [(s.src_start, s.src_end) for s in segments] == [(0, 1), (2, 3)]
    for content, reason in ((b"x", "not_a_pdf"), (b"%PDF-1.5 none", "no_pages"), (_pdf(b"q Q"), "no_text_layer"), (_pdf(b"(a) Tj", extra=b"/Subtype /Type0 "), "composite_font")):
        with pytest.raises(pdf.Refused) as e:
            pdf.pdf_text(content)
        assert e.value.reason == reason


def test_pdf_reading_orders():
    two = b"BT 1 0 0 1 50 700 Tm (L1) Tj 1 0 0 1 300 700 Tm (R1) Tj 1 0 0 1 50 680 Tm (L2) Tj 1 0 0 1 300 681 Tm (R2) Tj ET"
    assert pdf.pdf_text(_pdf(two), order="columns")[0] == "L1\nL2\nR1\nR2\n"
    assert pdf.pdf_text(_pdf(two), order="rows")[0] == "L1 R1\nL2 R2\n"


def test_floors_start_anew_only_past_the_last_floor():
    assert K.floors([0, 3, 6, 9, 13], 4) == [0, 6, 13]
    rng = random.Random(1)
    runs = [K.Placed(str(i), rng.random() * 100, rng.random() * 100) for i in range(40)]
    assert sorted(r.text for line in K.in_rows(runs) for r in line) == sorted(r.text for line in K.in_columns(runs) for r in line) == sorted(str(i) for i in range(40))
