"""Pages that the names of their elements say little about."""

import time

import pytest

from strandframe.llm.html_text import extract

P = "The committee met on Tuesday, and agreed on the plan for the harbour, which had been waiting for two years."
LOUD = "I really disagree with this, because, as always, the council, the mayor, and the rest forget the people who live here, and work here. " * 4

PAGES = {
    "heavier remarks beside the article": (f'<article><p>{P}</p><p>{P}</p></article><section class="discussion"><div class="response"><p>{LOUD}</p><p>{LOUD}</p></div></section>', [P, P]),
    "remarks of an unknown name": (f'<article><h1>T</h1><p>{P}</p><p>{P}</p></article><section class="reader-letters"><div class="vox"><p>{LOUD}</p></div></section>', ["T", P, P]),
    "remarks of an unknown name within main": (f'<main><article><p>{P}</p><p>{P}</p></article><div class="opinions"><p>{LOUD}</p><p>{LOUD}</p></div></main>', [P, P]),
    "comments of code": (f'<article><p>{P}</p><pre><code>x = 1 <span class="token comment"># why</span></code></pre><p class="comments">{P}</p></article>', [P, "x = 1 # why", P]),
    "an article that is a reply": (f'<article class="reply"><p>{P}</p><p>{P}</p></article>', [P, P]),
    "rows": (f'<div class="row"><div><p>{P}</p><p>{P}</p></div></div><div class="row"><div><p>The end of it.</p></div></div>', [P, P, "The end of it."]),
    "hidden elements": (
        f'<article><p>{P}</p><div hidden><p>{P} one</p></div><div style="color: red; display: none"><p>two</p></div><div aria-hidden="true">three</div><p class="is hidden">{P}</p></article>',
        [P, P],
    ),
    "notices": (f'<article><p>{P}</p><div class="alert alert-info">Note</div><div class="gdpr-box">We ask</div><p>{P}</p></article>', [P, P]),
    "cards beside a story": (
        f'<div id="story"><p>{P}</p><p>{P}</p><p>{P}</p></div><div class="cards"><article><p>A teaser <a href=x>of a link that is rather long</a></p></article><article><p>Short two</p></article></div>',
        [P, P, P],
    ),
}


@pytest.mark.parametrize("name", PAGES)
def test_pages_give_their_article_and_nothing_else(name):
    source, want = PAGES[name]
    assert extract(f"<html><body>{source}</body></html>") == "\n".join(want)


@pytest.mark.parametrize("part", ["<ul><li>", "<table><tr><td>", "<dl><dd>"])
def test_nested_lists_take_linear_time(part):
    last = part[part.rindex("<") :] if part != "<table><tr><td>" else "<tr><td>"
    began = time.time()
    extract(part * 4_000 + (last + "x") * 4_000)
    small = time.time() - began
    began = time.time()
    extract(part * 32_000 + (last + "x") * 32_000)
    assert time.time() - began < 8 * 3 * small + 1
