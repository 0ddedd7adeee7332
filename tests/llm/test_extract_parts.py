"""Pages whose classes, ids and parts mislead."""

import pytest

from meterline.llm import extract

LONG = "A sentence of the text, with some words in it, goes on for a while. " * 4
P = LONG.strip()


@pytest.mark.parametrize("page, want", [
    (f'<div id="page" class="site no-sidebar"><p>{P}</p><p>{P}</p></div>', [P, P]),
    (f'<article class="post comments-open"><p>{P}</p></article>', [P]),
    (f'<article class="comment"><p>{P}</p></article>', [P]),
    (f'<div class="widget"><p>{P}</p><p>{P}</p></div>', [P, P]),
    (f'<article><h2 id="related-work">Related work</h2><p>{P}</p><h2 id="discussion">Discussion</h2><p>{P}</p></article>',
     ["Related work", P, "Discussion", P]),
    (f'<article><p>{P}</p><p>{P}</p><section id="discussion"><h2>Discussion</h2><p>{P}</p></section><p>{P}</p></article>',
     [P, P, "Discussion", P, P]),
    (f'<article><p>{P}</p><p class="share-price">Shares rose, by two.</p><p>{P}</p></article>', [P, "Shares rose, by two.", P]),
    ('<article><p>One <span class="search-term">two</span> <b class="search">three</b>, four, and so on.</p></article>',
     ["One two three, four, and so on."]),
    (f'<article><p>{P}</p><p>{P}</p><div class="ad-box">Buy, now!</div><p>{P}</p></article>', [P, P, P]),
    (f'<article><p>{P}</p><div role="navigation"><p>{P}</p></div><p hidden>{P}</p></article>', [P]),
])
def test_marks(page, want):
    assert extract.main_text(page).split("\n\n") == want
