"""Whole articles from generated hosts, against the blocks they were made of."""

import random

import pytest

from probeforge.llm import html_wrapper

WORDS = "stone river light garden window bridge paper silver morning quiet letter harbour summer engine forest market signal winter copper valley".split()


def sentence(rng):
    return " ".join(rng.choices(WORDS, k=rng.randrange(8, 16))).capitalize() + "."


def article(rng, title):
    """(html inside the article, its blocks): headings and table heads are the same on all pages of a host."""
    blocks, html = [title], [f"<h1>{title}</h1>"]

    def add(tag, text):
        blocks.append(text)
        html.append(f"<{tag}>{text}</{tag}>")

    add("p", sentence(rng))
    for name in ("Summary", "Details"):
        add("h2", name)
        for _ in range(rng.randrange(1, 3)):
            add("p", sentence(rng))
    add("h3", "Figures")
    rows = [("Year", "Sales"), *((str(rng.randrange(1990, 2024)), str(rng.randrange(10_000, 99_999))) for _ in range(2))]
    html.append("<table>" + "".join("<tr>" + "".join(f"<{'th' if i == 0 else 'td'}>{c}</{'th' if i == 0 else 'td'}>" for c in r) + "</tr>" for i, r in enumerate(rows)) + "</table>")
    blocks += [c for r in rows for c in r]
    return "".join(html), blocks


FRAMES = {
    "article": "<article>{inner}</article>",
    "titled": "<article><header>{head}</header>{rest}</article>",
    "div": "<div class='content'>{inner}</div>",
    "divhead": "<div id='story-{n}'><header>{head}</header>{rest}</div>",
}


def page(frame, n, inner):
    head, rest = inner.split("</h1>", 1)
    held = FRAMES[frame].format(inner=inner, head=head + "</h1>", rest=rest, n=n)
    notice = "<div class='wrap'><h2>About this site</h2><p>This site is run by volunteers of the town.</p></div>"
    return (
        f"<html><head><title>t{n}</title></head><body><header><h1>The Daily Site</h1><p>News for all</p></header><nav><ul><li><a>Home</a></li><li><a>World</a></li></ul></nav>"
        f"<div class='page'>{held}{notice}</div><div class='comments'><p>{'x' * n} reader says hello</p></div><footer><p>All rights reserved {n}</p></footer></body></html>"
    )


@pytest.mark.parametrize("frame", FRAMES)
@pytest.mark.parametrize("n", [1, 2, 3, 5, 12])
def test_articles_are_whole(frame, n):
    rng = random.Random(n)
    made = [article(rng, f"Title {sentence(rng)}") for _ in range(n)]
    pages = [page(frame, i, inner) for i, (inner, _) in enumerate(made)]
    wrapper = html_wrapper.infer(pages)
    for html, (_, blocks) in zip(pages, made):
        got = html_wrapper.extract(html, wrapper).split("\n\n")
        if n >= html_wrapper.SUPPORT:
            assert got == blocks
        else:  # too few pages to tell template text inside the container
            assert [b for b in got if b in set(blocks)] == blocks


def test_near_copies_keep_their_title():
    rng = random.Random(7)
    inner, blocks = article(rng, "One title")
    copies = [(f"{inner}<p>Ending {i} {sentence(rng)}</p>", i) for i in range(3)]
    wrapper = html_wrapper.infer([page("article", i, html) for html, i in copies])
    for html, i in copies:
        got = html_wrapper.extract(page("article", i, html), wrapper)
        assert got.startswith("One title\n\n") and f"Ending {i} " in got and "The Daily Site" not in got and "Year\n\nSales" in got


def test_template_sections_go():
    """A heading with nothing but template under it goes with it; one of higher rank stays for what else it heads."""
    pages = [f"<html><body><article><h1>Title {i}</h1><p>Story {i} of today</p><section><h2>Follow</h2><p>Write to the desk.</p></section><h2>More</h2><p>Text {i}</p><table><tr><td>Call</td><td>555</td></tr></table></article></body></html>" for i in range(5)]
    wrapper = html_wrapper.infer(pages)
    assert html_wrapper.extract(pages[3], wrapper).split("\n\n") == ["Title 3", "Story 3 of today", "More", "Text 3"]
