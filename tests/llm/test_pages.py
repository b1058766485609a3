"""Main text of generated pages, whose article is known block by block."""

import html as escape
import random
import time

import pytest

from loomery.llm import html_text

WORDS = "river stone market letter garden winter window paper silver engine harbour music doctor valley story bridge summer".split()
JUNK = [
    "<nav><ul><li><a href=/>Home</a></li><li><a href=/a>About us</a></li></ul></nav>", "<footer><p>Imprint, terms, and privacy of this site.</p></footer>", "<aside><p>Popular today, and other things to read.</p></aside>",
    "<div class='cookie-banner'>We use cookies, as all do.</div>", "<form action=/s><input name=q><button>Search</button></form>", "<script>var p = '<p>no text, really</p>';</script>", "<style>p { color: red }</style>",
    "<div class=ad><p>Buy this now, it is cheap, and good.</p></div>", "<section class=comments><p>I disagree, strongly, with all of the above.</p></section>", "<!-- <p>an old paragraph, left out</p> -->",
    "<div role='navigation'><a href=/x>Next page</a></div>", "<div style='display: none'><p>Hidden words, not to be seen.</p></div>", "<noscript><p>Please turn scripts on, now.</p></noscript>",
]


class Writer:
    """Draws blocks; ``want`` has the text that each must give, in page order."""

    def __init__(self, seed: int):
        self.draw, self.want = random.Random(seed), []

    def words(self, least: int, most: int) -> str:
        return " ".join(self.draw.choice(WORDS) for _ in range(self.draw.randint(least, most)))

    def sentence(self) -> str:
        return f"{self.words(4, 9).capitalize()}, {self.words(4, 12)} & {self.words(1, 3)}."

    def inline(self, text: str) -> str:
        """A text as it may be marked up: entities, emphasis, breaks, odd white space, inline junk."""
        parts = [escape.escape(w) if self.draw.random() < 0.9 else f"<b>{escape.escape(w)}</b>" for w in text.split()]
        gaps = [self.draw.choice([" ", " ", " ", "\n  ", "<br>", "&nbsp;", " <!-- x > y --> ", "<script>a < b</script> "]) for _ in parts[1:]]
        return "".join(a + b for a, b in zip(parts, [*gaps, ""]))

    def said(self, tag: str, text: str, attributes: str = "") -> str:
        self.want.append(text)
        return f"<{tag}{attributes}>{self.inline(text)}" + ("" if tag in ("p", "li", "dd", "dt") and self.draw.random() < 0.4 else f"</{tag}>")

    def block(self, depth: int) -> str:
        kind = self.draw.choice(["p"] * 6 + ["h2", "h3", "ul", "ol", "quote", "pre", "table", "dl", "figure", "nest", "nest", "prose"])
        if kind == "p":
            return self.said("p", " ".join(self.sentence() for _ in range(self.draw.randint(1, 5))))
        if kind in ("h2", "h3"):
            return self.said(kind, self.words(1, 5).capitalize(), self.draw.choice(["", " class=share"]))
        if kind in ("ul", "ol"):
            return f"<{kind}>" + "".join(self.said("li", self.words(1, 8)) for _ in range(self.draw.randint(1, 4))) + f"</{kind}>"
        if kind == "quote":
            return "<blockquote>" + self.said("p", self.sentence()) + "</blockquote>"
        if kind == "pre":
            return self.said("pre", self.words(2, 6))
        if kind == "table":
            return "<table>" + "".join("<tr>" + self.said("td", self.words(1, 3)) + self.said("td", self.words(1, 3)) for _ in range(2)) + "</table>"
        if kind == "dl":
            return "<dl>" + self.said("dt", self.words(1, 2)) + self.said("dd", self.sentence()) + "</dl>"
        if kind == "figure":
            return "<figure><img src=x>" + self.said("figcaption", self.sentence()) + "</figure>"
        if kind == "prose":
            return "<div class='share-of-voice'>" + self.said("p", self.sentence()) + "</div>"
        if depth > 5:
            return self.said("p", self.sentence())
        tag = self.draw.choice(["div", "section"])
        return f"<{tag} id=s{depth}>" + "".join(self.block(depth + 1) for _ in range(self.draw.randint(1, 3))) + f"</{tag}>"

    def page(self, frame: str) -> str:
        junk = lambda: "".join(self.draw.sample(JUNK, self.draw.randint(0, 4)))
        before, after = junk(), junk()
        body = []
        for _ in range(self.draw.randint(3, 14)):
            body.append(self.block(0))
            if self.draw.random() < 0.2:
                body.append(self.draw.choice([j for j in JUNK if "nav" not in j]))
        return f"<!doctype html><html><head><title>Not this</title></head><body>{before}{frame.format(''.join(body))}{after}</body></html>"


FRAMES = ["<article>{}</article>", "<main><div>{}</div></main>", "<div><div class=wrapper><article class='post related-view'>{}</article></div></div>"]


@pytest.mark.parametrize("frame", FRAMES)
@pytest.mark.parametrize("seed", range(60))
def test_every_block_of_an_article_and_no_other(frame, seed):
    w = Writer(seed)
    page = w.page(frame)
    assert html_text.main_text(page).split("\n\n") == w.want


@pytest.mark.parametrize("seed", range(40))
def test_containers_without_a_name(seed):
    """Without an article element: all paragraphs of a div that has long ones, beside junk."""
    w = Writer(seed)
    parts = [w.said("p", " ".join(w.sentence() for _ in range(6))) for _ in range(5)] + [f"<div>{w.said('p', w.sentence())}</div>", f"<section>{w.said('p', w.words(2, 4))}</section>", w.said("h4", w.words(1, 3))]
    page = f"<body>{JUNK[0]}<div id=x>{JUNK[3]}<div>{''.join(parts[:5])}</div>{''.join(parts[5:])}</div>{JUNK[1]}</body>"
    assert html_text.main_text(page).split("\n\n") == w.want


def test_formulas_and_references_stay():
    p = "<p>One paragraph, of some length, with words and, of course, commas in it.</p>"
    got = html_text.main_text(f"<article>{p}{p}<p>Let <math><mi>x</mi><mo>=</mo><annotation>tex</annotation></math> be.</p><ol><li><a href=1>Author, Title</a></li><li><a href=2>Other</a></li></ol><ul><li><a href=3>Author, A Title of a book. Publisher.</a></li></ul><ul><li><a href=/>Home</a></li><li><a href=/n>Next story</a></li></ul></article>")
    assert got.split("\n\n")[2:] == ["Let x= be.", "Author, Title", "Other", "Author, A Title of a book. Publisher."]


@pytest.mark.parametrize("page", ["<div>a" * 100_000, "<b>a" * 60_000 + "<div>x</b>" * 60_000, "<div class='x comments-y'>a" * 50_000 + "</span>" * 50_000 + "<p>x</section>" * 50_000, "<ul><li>" * 60_000 + "<a href=x>" * 60_000, "<p><td>" * 60_000, "<!--" * 100_000, "<a " * 200_000])
def test_time_grows_with_the_page(page):
    began = time.time()
    html_text.main_text(page)
    assert time.time() - began < 20
