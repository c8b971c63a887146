"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page, decoded by Viterbi.

A leaf block is the text between two block-level tags. Its features are the tags, classes and ids of all its ancestors and
properties of its text; labels are main text or not. The field is trained once in a driver process, by gradient ascent on the exact
log-likelihood (forward-backward) over labelled pages that ``html_training`` makes: their number is the documented bound. With two
labels a feature has one weight, the difference between the labels, so the weights are a few hundred numbers, whatever the corpus.

Scale: one pass over the pages, no shuffle; a page is worked on by itself in time linear in its length.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, html_training

#: Labelled pages that the field is trained on, and passes over them.
TRAINING_PAGES, PASSES = 300, 6

_BLOCKS = frozenset(
    "address article aside blockquote body br caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their contents are no text of the page.
_SILENT = frozenset("script style head title template textarea select button noscript iframe object svg math canvas audio video".split())
#: What may stand in a head; any other tag, or text, ends it.
_HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
_RAW = frozenset("script style title textarea iframe noscript".split())
_TAG = re.compile(r"<(?:!--(?:.*?--!?>|.*\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+)(?:>|\Z)|[!?/][^>]*+(?:>|\Z))", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = frozenset("ul ol dl table div article section aside nav main header footer form body html td th figure blockquote".split())


@cache
def _ancestor(tag: str, attributes: str) -> tuple[str, ...]:
    """Features that an element gives to all blocks in it."""
    out = ["in:" + tag]
    for m in _NAMES.finditer(attributes):
        out += ["name:" + x for x in dict.fromkeys(_PART.findall((m[1] or m[2] or m[3] or "").lower()))]
    return tuple(out)


def _own(tag: str, text: str, linked: int) -> tuple[str, ...]:
    n = len(text)
    words = text.count(" ") + 1
    share = linked / n
    return (
        "tag:" + tag,
        f"words:{min(6, words.bit_length())}",
        "links:" + ("0" if share < 0.1 else "1" if share < 0.6 else "2"),
        "end:" + ("." if text[-1] in ".!?…。:;\"”»" else "-"),
        "comma:" + str("," in text),
        "sign:" + str("©" in text or "®" in text),
    )


class Element:
    """An open element: its features, the element that it is in, and the sum of scores down to it once that is known. Blocks share them."""

    __slots__ = ("features", "field", "parent", "score", "tag")

    def __init__(self, tag: str, features: tuple[str, ...], parent: Element | None):
        self.tag, self.features, self.parent, self.field, self.score = tag, features, parent, None, 0.0

    def above(self) -> Iterator[tuple[str, ...]]:
        at: Element | None = self
        while at is not None:
            yield at.features
            at = at.parent


def blocks(page: str) -> Iterator[tuple[str, Element | None, tuple[str, ...]]]:
    """Text, innermost element, own features of each leaf block with any text, in page order. Time and memory are linear in the page."""
    stack: list[Element] = []
    open_: Counter[str] = Counter()
    silent = links = 0
    parts: list[str] = []
    linked, at, block = 0, 0, "body"
    size = len(page)

    def flush():
        nonlocal linked
        text = " ".join("".join(parts).split())
        parts.clear()
        share, linked = min(linked, len(text)), 0
        return (text, stack[-1] if stack else None, _own(block, text, share)) if text else None

    def leave(to: int) -> None:
        nonlocal silent, links
        while len(stack) > to:
            t = stack.pop().tag
            open_[t] -= 1
            silent -= t in _SILENT
            links -= t == "a"

    while at < size:
        m = _TAG.search(page, at)
        stop = m.start() if m else size
        if stop > at and stack and stack[-1].tag == "head" and page[at:stop].strip():
            leave(len(stack) - 1)
        if stop > at and not silent:
            text = page[at:stop]
            if "&" in text:
                text = html.unescape(text)
            parts.append(text)
            if links:
                linked += len(text)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        closing = bool(m[1])
        if tag in _BLOCKS and parts:
            found = flush()
            if found:
                yield found
        if not closing:
            if stack and stack[-1].tag == "head" and tag not in _HEAD:
                leave(len(stack) - 1)
            ends = _CLOSES.get(tag, ())
            if (ends or (tag in _BLOCKS and tag != "br")) and (open_["p"] or any(open_[x] for x in ends)):
                for i in range(len(stack) - 1, -1, -1):
                    name = stack[i].tag
                    if name in ends or name == "p":
                        leave(i)
                        if name != "p":
                            break
                    elif name in _SCOPES:
                        break
            if tag not in _VOID and not (m[3] or "").endswith("/"):
                if tag in _RAW:
                    end = re.compile(f"</{tag}(?=[\\s/>]|\\Z)", re.I).search(page, at)
                    at = end.start() if end else size
                stack.append(Element(tag, _ancestor(tag, m[3] or ""), stack[-1] if stack else None))
                open_[tag] += 1
                silent += tag in _SILENT
                links += tag == "a"
                if tag in _BLOCKS:
                    block = tag
        else:
            if open_[tag]:
                leave(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag))
            if tag in _BLOCKS:
                block = next((e.tag for e in reversed(stack) if e.tag in _BLOCKS), "body")
    found = flush()
    if found:
        yield found


class Field:
    """Weights: of features, of keeping or changing the label (to[before][after]), and of the first label."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.to = [[0.0, 0.0], [0.0, 0.0]]
        self.first = [0.0, 0.0]
        self.sums: dict[tuple[str, ...], float] = {}

    def score(self, features: tuple[str, ...]) -> float:
        got = self.sums.get(features)
        if got is None:
            got = self.sums[features] = sum(self.weights.get(f, 0.0) for f in features)
            if len(self.sums) > 100_000:
                self.sums.clear()
        return got

    def down_to(self, element: Element | None) -> float:
        """Scores of an element and all that it is in; each element of a page is summed once."""
        chain = []
        while element is not None and element.field is not self:
            chain.append(element)
            element = element.parent
        total = element.score if element is not None else 0.0
        for e in reversed(chain):
            total += self.score(e.features)
            e.field, e.score = self, total
        return total

    def scores(self, page: list) -> list[float]:
        return [self.down_to(element) + self.score(own) for _, element, own in page]

    def decode(self, scores: list[float]) -> list[int]:
        """Viterbi: the most likely labels; label 1 scores as given, label 0 nothing."""
        (a, b), (c, d) = self.to
        no, yes = self.first[0], self.first[1] + scores[0]
        back = []
        for s in scores[1:]:
            from_no, from_yes = no + a >= yes + c, no + b > yes + d
            back.append((0 if from_no else 1, 0 if from_yes else 1))
            no, yes = (no + a if from_no else yes + c), (no + b if from_yes else yes + d) + s
        label = int(yes > no)
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return out[::-1]


def _log_sum(x: float, y: float) -> float:
    m = max(x, y)
    return m + math.log(math.exp(x - m) + math.exp(y - m))


def train(pages: list[tuple[list, list[int]]], passes: int = PASSES, rate: float = 0.3, decay: float = 1e-3, seed: int = 5) -> Field:
    """Stochastic gradient ascent (AdaGrad steps) on the exact log-likelihood; pages are (blocks, labels)."""
    field, seen = Field(), {}
    order = random.Random(seed)

    def step(key, get, put, gradient):
        seen[key] = seen.get(key, 1e-8) + gradient * gradient
        put(get() + rate * gradient / math.sqrt(seen[key]))

    for _ in range(passes):
        pages = order.sample(pages, len(pages))
        for page, labels in pages:
            if not page:
                continue
            field.sums.clear()
            for _, element, _ in page:  # the weights have moved
                while element is not None and element.field is not None:
                    element.field, element = None, element.parent
            s, n = field.scores(page), len(page)
            f = [[field.first[0], field.first[1] + s[0]]]
            for x in s[1:]:
                p = f[-1]
                f.append([_log_sum(p[0] + field.to[0][0], p[1] + field.to[1][0]), _log_sum(p[0] + field.to[0][1], p[1] + field.to[1][1]) + x])
            b = [[0.0, 0.0]]
            for x in reversed(s[1:]):
                q = b[-1]
                b.append([_log_sum(q[0] + field.to[y][0], q[1] + x + field.to[y][1]) for y in (0, 1)])
            b.reverse()
            z = _log_sum(*f[-1])
            likely = [math.exp(f[i][1] + b[i][1] - z) for i in range(n)]
            pairs = {(u, v): 0.0 for u in (0, 1) for v in (0, 1)}
            for i in range(1, n):
                for u, v in pairs:
                    pairs[u, v] += (labels[i - 1] == u and labels[i] == v) - math.exp(f[i - 1][u] + field.to[u][v] + (s[i] if v else 0.0) + b[i][v] - z)
            changes: dict[str, float] = {}
            for i, (_, element, own) in enumerate(page):
                error = labels[i] - likely[i]
                for group in (*(element.above() if element else ()), own):
                    for name in group:
                        changes[name] = changes.get(name, 0.0) + error
            for name, g in changes.items():
                w = field.weights.get(name, 0.0)
                g -= decay * w
                seen[name] = seen.get(name, 1e-8) + g * g
                field.weights[name] = w + rate * g / math.sqrt(seen[name])
            for (u, v), g in pairs.items():
                step((u, v), lambda: field.to[u][v], lambda x: field.to[u].__setitem__(v, x), g)
            for y in (0, 1):
                g = (labels[0] == y) - (likely[0] if y else 1 - likely[0])
                step(y, lambda: field.first[y], lambda x: field.first.__setitem__(y, x), g)
    field.sums.clear()
    return field


@cache
def trained(pages: int = TRAINING_PAGES, seed: int = 11) -> Field:
    """The field that queries use."""
    return train([html_training.labelled(page, blocks) for page in html_training.pages(pages, seed)])


def main_text(page: str | None, field: Field) -> str:
    """The main text's blocks, in page order, joined by one space."""
    found = list(blocks(page or ""))
    if not found:
        return ""
    return " ".join(b[0] for b, keep in zip(found, field.decode(field.scores(found)), strict=True) if keep)


def extract(pages: DataFrame, *, html_col: str = "html", into: str = "text", field: Field | None = None) -> DataFrame:
    """All input columns but the html, and ``into``: the main text, empty if there is none (also for null html).

    A column named like ``into`` is replaced, no other is touched; a tie of the two labelings of a block leaves it out; a very long page takes
    memory of some 20 times its length in one worker; repeated rows get equal texts; an empty table gives no rows.
    """
    field = field or trained()
    page = common.fresh([*pages.columns, into], "page")
    pages = pages.select(*(F.col(f"`{c}`") for c in pages.columns if c not in (into, html_col)), F.col(html_col).cast("string").alias(page))
    names = pages.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, field) for x in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*names, into])

    return pages.mapInArrow(run, T.StructType([*pages.schema.fields[:-1], T.StructField(into, T.StringType())]))
