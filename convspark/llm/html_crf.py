"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A page is cut into leaf blocks: runs of inline text under one chain of block elements. A block has features of its
ancestors (tags, words of their class, id and role) and of its text (length, sentence ends, share of links, place).
The field weighs features for each label and the change of label from block to block; it is trained by gradient
steps on the log-likelihood of labelled pages and decoded by Viterbi.

Labelled pages are those whose markup states their parts: blocks in ``article`` or ``main`` and in no part that says
otherwise are text, the others are not. So that the field does not lean on those tags alone, half of the pages are
seen a second time without them, and with labelled notices, menus and comments set between their blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements by their kind in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript head title svg math iframe object canvas textarea select datalist audio video".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
PARAGRAPH_ENDS = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: What an element ends if it is still open: an item the item before it, and so on.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table article section div main nav aside body".split())
#: Parts that are never text, by tag and by words of class, id and role.
OTHER_TAGS = frozenset("nav aside footer header form button menu dialog".split())
OTHER_WORDS = frozenset(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments respond reply replies cookie consent gdpr notice popup modal overlay newsletter subscribe signup login related recommended share sharing social sidebar side widget menu nav navigation navbar footer header masthead promo promoted sponsor sponsored toolbar pagination pager tags meta byline".split()
)
MAIN_TAGS = frozenset(("article", "main"))
#: What a head may hold; any other element ends it, as text does.
HEAD_TAGS = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
FOREIGN = frozenset(("svg", "math"))
BUCKETS = 1 << 14
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_LONG_NUMBER = re.compile(r"&#([0-9]{8,});?")


@dataclass(frozen=True)
class Rules:
    """``pages``: bound of the training sample, drawn by a hash of the ids."""

    pages: int = 400
    rounds: int = 6
    rate: float = 0.2
    decay: float = 1e-5
    seed: int = 11


@dataclass
class Block:
    text: str
    tags: tuple[str, ...]
    marks: tuple[str, ...]
    linked: int


class BlockParser(HTMLParser):
    """Cuts a page into leaf blocks in page order; white space inside a block becomes one space."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.silent = 0
        self.links = 0
        self.parts: list[str] = []
        self.linked = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in HEAD_TAGS:
            self._end_head(anywhere=tag == "body")
        if tag in VOID:
            if tag == "br" or tag == "hr":
                self._text(" ")
            if tag == "hr":
                self._end_block()
            return
        if tag not in INLINE:
            self._end_block()
            if tag in PARAGRAPH_ENDS:
                self._close_until("p")
            for other in ENDS.get(tag, ()):
                self._close_until(other)
        marks = tuple(
            w.lower() for name, value in attrs if value and name in ("class", "id", "role", "itemprop", "aria-label") for w in _WORD.findall(value)
        )
        if any(name == "hidden" or (name == "style" and value and re.search(r"display\s*:\s*none", value)) for name, value in attrs):
            marks += ("hidden",)
        self.open.append((tag, marks))
        self.silent += tag in SILENT
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        # only foreign elements close themselves; elsewhere the stroke means nothing
        if tag not in VOID and self._in_foreign():
            self._pop(len(self.open) - 1)

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """In HTML a section is a comment up to the next ``>``, whatever its keyword; only foreign elements have CDATA."""
        if self._in_foreign() and self.rawdata.startswith("<![CDATA[", i):
            return super().parse_marked_section(i, report)
        return self.parse_bogus_comment(i)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self._end_block()
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == tag:
                self._pop(at)
                return
            if tag in INLINE and self.open[at][0] not in INLINE:
                return

    def handle_data(self, data: str) -> None:
        if data.strip(" \t\n\r\f"):
            self._end_head()
        self._text(data)

    def close(self) -> None:
        super().close()
        self._end_block()

    def _text(self, data: str) -> None:
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)

    def _in_foreign(self) -> bool:
        return any(name in FOREIGN for name, _ in self.open)

    def _end_head(self, anywhere: bool = False) -> None:
        """Ends a head that is open still: the innermost element, or ``anywhere``."""
        for at in range(len(self.open) - 1, -1, -1):
            if self.open[at][0] == "head":
                self._pop(at)
                return
            if not anywhere:
                return

    def _close_until(self, tag: str) -> None:
        for at in range(len(self.open) - 1, -1, -1):
            name = self.open[at][0]
            if name == tag:
                self._pop(at)
                return
            if name in SCOPES:
                return

    def _pop(self, at: int) -> None:
        for name, _ in self.open[at:]:
            self.silent -= name in SILENT
            self.links -= name == "a"
        del self.open[at:]

    def _end_block(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                held = [(t, m) for t, m in self.open if t not in INLINE or m]
                self.blocks.append(Block(text, tuple(t for t, _ in held if t not in INLINE), tuple(w for _, m in held for w in m), self.linked))
            self.parts = []
        self.linked = 0


def _short_number(found: re.Match) -> str:
    """A character number that can be read: without zeros before it, and beyond Unicode as the replacement character."""
    digits = found[1].lstrip("0") or "0"
    return f"&#{digits};" if len(digits) < 8 else "&#xFFFD;"


def blocks_of(html: str | None) -> list[Block]:
    """The leaf blocks of a page, which may be cut short or broken anywhere; character numbers may have any length."""
    parser = BlockParser()
    parser.feed(_LONG_NUMBER.sub(_short_number, html or ""))
    parser.close()
    return parser.blocks


def states_parts(blocks: list[Block]) -> bool:
    return any(MAIN_TAGS.intersection(b.tags) for b in blocks)


def stated_labels(blocks: list[Block]) -> list[int]:
    return [
        int(bool(MAIN_TAGS.intersection(b.tags)) and not OTHER_TAGS.intersection(b.tags) and not OTHER_WORDS.intersection(b.marks) and "hidden" not in b.marks)
        for b in blocks
    ]


def _size(n: int) -> int:
    return n.bit_length()


def features(blocks: list[Block], masked: bool = False) -> list[list[int]]:
    """Numbers of the features of each block. ``masked``: without the tags that state the main part."""
    import zlib

    out = []
    last = len(blocks) - 1
    for n, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        tags = [t for t in b.tags if t not in MAIN_TAGS] if masked else b.tags
        ends = b.text[-1]
        names = [
            "bias",
            f"words {_size(words)}",
            f"end {'.' if ends in '.!?…。' else ',' if ends in ',;:' else 'a'}",
            f"stops {min(4, b.text.count('. '))}",
            f"linked {4 * b.linked // max(len(b.text), 1)}",
            f"leaf {tags[-1] if tags else ''}",
            f"leaf {tags[-1] if tags else ''} {_size(words)}",
            f"depth {min(len(tags), 12)}",
            f"place {_size(n)}",
            f"left {_size(last - n)}",
        ]
        names += [f"tag {t}" for t in set(tags)]
        names += [f"mark {m}" for m in set(b.marks)]
        if OTHER_WORDS.intersection(b.marks):
            names.append("marked as other")
        if any(t in OTHER_TAGS for t in tags):
            names.append("in other part")
        out.append([zlib.crc32(f.encode("utf-8", "replace")) % BUCKETS for f in names])
    return out


@dataclass
class Field:
    """``weights``: for each label and feature; ``moves``: for each label and the next one."""

    weights: np.ndarray
    moves: np.ndarray

    def emissions(self, rows: list[list[int]]) -> np.ndarray:
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((f for r in rows for f in r), np.int64, int(sizes.sum()))
        return np.add.reduceat(self.weights[:, flat], np.cumsum(sizes) - sizes, axis=1).T

    def decode(self, rows: list[list[int]]) -> list[int]:
        """The most probable labels (Viterbi)."""
        if not rows:
            return []
        e = self.emissions(rows).tolist()
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b = e[0]
        back = []
        for x, y in e[1:]:
            from0, from1 = a + m00 >= b + m10, a + m01 > b + m11
            back.append((0 if from0 else 1, 0 if from1 else 1))
            a, b = (a + m00 if from0 else b + m10) + x, (a + m01 if from1 else b + m11) + y
        label = int(b > a)
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def train_field(pages: list[tuple[list[list[int]], list[int]]], rules: Rules) -> Field:
    """Gradient steps with a step size for each weight, page by page, in an order drawn by the seed."""
    draw = np.random.default_rng(rules.seed)
    field = Field(np.zeros((2, BUCKETS)), np.zeros((2, 2)))
    squares, move_squares = np.full((2, BUCKETS), 1e-6), np.full((2, 2), 1e-6)
    for _ in range(rules.rounds):
        for n in draw.permutation(len(pages)):
            rows, labels = pages[n]
            e = field.emissions(rows)
            count = len(rows)
            forward, backward = np.empty_like(e), np.zeros_like(e)
            forward[0] = e[0]
            for t in range(1, count):
                forward[t] = e[t] + _log_sum(forward[t - 1][:, None] + field.moves, 0)
            for t in range(count - 2, -1, -1):
                backward[t] = _log_sum(field.moves + (e[t + 1] + backward[t + 1])[None, :], 1)
            whole = _log_sum(forward[-1], 0)
            p = np.exp(forward + backward - whole)
            truth = np.zeros_like(p)
            truth[np.arange(count), labels] = 1
            slope = truth - p
            gradient = np.zeros((2, BUCKETS))
            for t, row in enumerate(rows):
                gradient[:, row] += slope[t][:, None] / count
            used = np.unique(np.concatenate([np.asarray(r) for r in rows]))
            g = gradient[:, used] - rules.decay * field.weights[:, used]
            squares[:, used] += g * g
            field.weights[:, used] += rules.rate * g / np.sqrt(squares[:, used])
            if count > 1:
                pair = np.exp(forward[:-1, :, None] + field.moves[None] + (e[1:] + backward[1:])[:, None, :] - whole).sum(axis=0)
                seen = np.zeros((2, 2))
                np.add.at(seen, (labels[:-1], labels[1:]), 1)
                g = (seen - pair) / count
                move_squares += g * g
                field.moves += rules.rate * g / np.sqrt(move_squares)
    return field


#: Parts that are set between the blocks of a page for training: tags, words of class or id, sizes in words, links.
NOTICES = (
    (("div", "p"), ("cookie", "notice"), (6, 30), False),
    (("div",), ("banner",), (3, 15), False),
    (("div", "div"), ("ad",), (3, 20), False),
    (("aside", "p"), (), (5, 40), False),
    (("aside", "div", "ul", "li"), ("sidebar", "related"), (2, 8), True),
    (("div", "ul", "li"), ("share", "social"), (1, 3), True),
    (("header", "p"), (), (2, 10), False),
    (("form", "p"), (), (2, 12), False),
    (("section", "div", "p"), ("comments", "comment"), (5, 60), False),
    (("div", "div", "p"), ("comment", "body"), (5, 60), False),
    (("ol", "li", "div"), ("comments", "reply"), (4, 50), False),
    (("div", "p"), ("newsletter", "subscribe"), (4, 20), False),
    (("footer", "p"), (), (3, 20), False),
    (("nav", "ul", "li"), (), (1, 3), True),
)


def mixed_page(blocks: list[Block], labels: list[int], draw: np.random.Generator) -> tuple[list[Block], list[int]]:
    """The page with three labelled parts set between, before and after its blocks; their words come from the page."""
    words = " ".join(b.text for b in blocks).split() or ["x"]
    page, marks = list(blocks), list(labels)
    for _ in range(3):
        tags, own, (least, most), linked = NOTICES[draw.integers(len(NOTICES))]
        at = int(draw.choice([0, len(page), draw.integers(len(page) + 1)]))
        around = page[min(at, len(page) - 1)].tags[:-1] if draw.random() < 0.5 and page else ("html", "body")
        for _ in range(int(draw.integers(1, 5))):
            first = int(draw.integers(len(words)))
            text = " ".join(words[first : first + int(draw.integers(least, most + 1))])
            page.insert(at, Block(text, (*around, *tags), own, len(text) if linked else 0))
            marks.insert(at, 0)
    return page, marks


def train(pages: DataFrame, rules: Rules | None = None) -> Field | None:
    """A field from at most about ``rules.pages`` pages whose markup states their parts; None if there is no such page."""
    rules = rules or Rules()
    html = F.lower("html")
    labelled = pages.select("page_id", "html").where(html.contains("<article") | html.contains("<main"))
    total = labelled.count()
    if not total:
        return None
    draw = F.pmod(F.xxhash64("page_id"), F.lit(1_000_003)) / 1_000_003.0
    # the order makes the sample the same whatever the layout of the table
    drawn = labelled.where(draw < min(1.0, rules.pages / total)).orderBy(F.xxhash64("page_id"), F.xxhash64("html"))
    rows = sorted(drawn.limit(2 * rules.pages).collect(), key=lambda r: (r["page_id"] is not None, r["page_id"] or 0))
    seeded = np.random.default_rng(rules.seed)
    examples = []
    for row in rows or labelled.orderBy(F.xxhash64("page_id"), F.xxhash64("html")).limit(1).collect():
        blocks = blocks_of(row["html"])
        if not states_parts(blocks):
            continue
        labels = stated_labels(blocks)
        examples.append((features(blocks), labels))
        mixed, marks = mixed_page(blocks, labels, seeded)
        examples.append((features(mixed, masked=bool(seeded.random() < 0.5)), marks))
    return train_field(examples, rules) if examples else None


def main_text(html: str | None, field: Field | None) -> str:
    """The text of a page; without a field every block counts as text."""
    blocks = blocks_of(html)
    labels = field.decode(features(blocks)) if field else [1] * len(blocks)
    return "\n\n".join(b.text for b, label in zip(blocks, labels) if label)


def main_text_column(html: Column, field: Field | None, spark) -> Column:
    shared = spark.sparkContext.broadcast(field)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for batch in batches:
            yield pd.Series([main_text(h, own) for h in batch], dtype="object")

    return run(html)


def extract(pages: DataFrame, rules: Rules | None = None, field: Field | None = None) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars`` (code points) of every page. Null and empty pages, and pages of which
    no block is text, give an empty text; rows with null ids and repeated rows stay; other columns are ignored.
    Without a ``field`` one is trained on the pages that state their parts."""
    field = field or train(pages, rules)
    found = pages.select("page_id", "url", main_text_column(F.col("html"), field, pages.sparkSession).alias("text"))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))
