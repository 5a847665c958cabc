from __future__ import annotations

import random

import numpy as np
import pytest

from convspark.llm import html_crf

WORDS = "stone river of light and the old house in winter where people sing about bread with slow hands".split()


def sentence(draw, n):
    return " ".join(draw.choices(WORDS, k=n)).capitalize() + "."


def page(draw, kind):
    """A page and the blocks of its article. ``kind``: which parts there are and how they are marked."""
    body = [sentence(draw, draw.randint(8, 40)) for _ in range(draw.randint(2, 6))]
    head = sentence(draw, 5)[:-1]
    nav = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in draw.sample(WORDS, 4))
    text = f"<h1>{head}</h1>" + "".join(f"<p>{b}</p>" if n % 2 else f"<p><b>{b}<br>" for n, b in enumerate(body))
    opened, closed = ("<article>", "</article>") if kind != "plain" else ('<div class="post-content">', "</div>")
    extra = ""
    if kind in ("rich", "plain"):
        extra = (
            f'<section class="comments"><h3>Comments</h3><div class="comment"><p>{sentence(draw, 12)}</p></div></section>'
            f'<aside class="sidebar"><ul>{nav}</ul></aside><form><label>Mail</label><button>Send</button></form>'
        )
    cookie = f'<div class="cookie-notice"><p>{sentence(draw, 9)}</p></div>' if kind != "bare" else ""
    html = (
        f"<!DOCTYPE html><html><head><title>{head}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{cookie}<nav><ul>{nav}</ul></nav>"
        f'<div class="ad">{sentence(draw, 6)}</div>{opened}{text}{closed}{extra}<footer>&copy; {sentence(draw, 4)}</footer>'
    )
    return html, [head, *body]


@pytest.fixture(scope="module")
def field():
    draw, seeded = random.Random(1), np.random.default_rng(1)
    examples = []
    for _ in range(150):
        blocks = html_crf.blocks_of(page(draw, draw.choice(("bare", "rich")))[0])
        labels = html_crf.stated_labels(blocks)
        examples.append((html_crf.features(blocks), labels))
        mixed, marks = html_crf.mixed_page(blocks, labels, seeded)
        examples.append((html_crf.features(mixed, masked=bool(seeded.random() < 0.5)), marks))
    return html_crf.train_field(examples, html_crf.Rules())


@pytest.mark.parametrize("kind,least", [("bare", 0.99), ("rich", 0.98), ("plain", 0.9)])
def test_held_out_pages(field, kind, least):
    """Share of blocks that are right on pages of kinds seen (bare, rich) and not seen in training (plain)."""
    draw, right, total = random.Random(2), 0, 0
    for _ in range(60):
        html, body = page(draw, kind)
        found = html_crf.main_text(html, field).split("\n\n")
        right += len(set(found) & set(body))
        total += len(set(found) | set(body))
    assert right >= least * total


def test_blocks():
    html = "<p>A &amp; B&nbsp;c\n d<b>e</b>f<p>g<ul><li>h<li>i</ul>j<script>k<p></script><!-- l --><table><tr><td>m<td>n</table>&#x41;&lt;"
    assert [b.text for b in html_crf.blocks_of(html)] == ["A & B c def", "g", "h", "i", "j", "m", "n", "A<"]
    assert [b.tags for b in html_crf.blocks_of("<div><p>x</div>y")] == [("div", "p"), ()]


@pytest.mark.parametrize(
    "html",
    [
        "<html><head><title>t</title><body><p>A<p>B</body></html>",
        "<html><head><meta charset=utf-8><title>t</title><p>A</p><p>B</p>",
        "<head><title>t</title>\n A <p>B",
        "<head><noscript><img src=x>n</noscript><title>t</title></head><p>A<p>B",
        "<body><p><svg width=9 />A<p>B",
        "<body><p><math/>A<p>B",
        "<body><p><svg><title/><g><path d=x /><text>s</text></g></svg>A<p>B",
        "<p>A<p>B<svg><![CDATA[ x > <p>y ]]></svg>",
        "<p>A<![word x]><p>B",
        "<p>A<![ x]><p>B",
        "<p>A<![endif]--><p>B<!-- ]> -->",
        "<p>A<![if !x]><p>B<![endif]>",
    ],
)
def test_no_text_is_lost_after_optional_tags_and_odd_declarations(html):
    assert [b.text for b in html_crf.blocks_of(html)] == ["A", "B"]


def test_viterbi_is_the_best_path():
    draw = np.random.default_rng(3)
    for _ in range(30):
        field = html_crf.Field(draw.normal(size=(2, html_crf.BUCKETS)), draw.normal(size=(2, 2)))
        rows = [[int(x) for x in draw.integers(0, html_crf.BUCKETS, 3)] for _ in range(6)]
        e = field.emissions(rows)
        paths = [[n >> k & 1 for k in range(6)] for n in range(64)]
        best = max(paths, key=lambda p: sum(e[k, p[k]] for k in range(6)) + sum(field.moves[a, b] for a, b in zip(p, p[1:])))
        assert field.decode(rows) == best


def test_extract_trains_on_the_table(spark):
    draw = random.Random(4)
    pages = [(n, f"http://h/{n}", *page(draw, "rich")) for n in range(80)]
    found = html_crf.extract(spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")).collect()
    truth = {n: "\n\n".join(body) for n, _, _, body in pages}
    assert sum(r["text"] == truth[r["page_id"]] for r in found) >= 72
    assert all(r["n_chars"] == len(r["text"]) for r in found)


@pytest.mark.parametrize("number,shown", [("9" * 5_000, "\ufffd"), ("0" * 5_000 + "65", "A"), ("99999999", "\ufffd"), ("0", "\ufffd")])
def test_text_behind_long_character_numbers_stays(number, shown):
    page = f"<p>first</p><p>a &#{number}; b</p><p>c &#{number} d</p><p title='&#{number}'>third</p>"
    assert [b.text for b in html_crf.blocks_of(page)] == ["first", f"a {shown} b", f"c {shown} d", "third"]


def test_broken_pages_are_read_to_their_end():
    """Pieces of markup in any order, cut anywhere: no error, and a paragraph after them is there unless it is hidden."""
    draw = random.Random(4)
    pieces = ["<p>", "</p>", "<![", "<![if x]>", "<!", "<!-", "<!-->", "</", "<?x", "&#", "&#x;", "&#x110000;", "&#55296", "<a href='", ">", "'", "]]>", "<![CDATA[", "<svg/>", "<!DOCTYPE", "<b <i>", "x", "<", "&amp", "<!ELEMENT [", "<br/"]
    for _ in range(3_000):
        broken = "".join(draw.choices(pieces, k=draw.randint(1, 9)))
        blocks = html_crf.blocks_of(f"<p>before</p>{broken}")
        assert blocks[0].text.startswith("before")
    for piece in ("<![word", "<!", "</>", "<?x", "<![if x]", "<!ELEMENT [", "&#x;", "&#" + "9" * 9_000):
        assert html_crf.blocks_of(f"<p>before {piece}></p><p>after</p>")[-1].text == "after"
