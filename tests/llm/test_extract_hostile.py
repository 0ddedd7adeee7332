"""Pages built to cost much, or with attributes that mislead the tokens."""

import time
import tracemalloc

import pytest

from meterline.llm import extract

N = 20_000


@pytest.mark.parametrize("page", [
    "<div>x, y" * N,
    "<b>x, y" * N,
    "<b>" * N + "<p>x, y</p>" * N,
    "<div>" * N + "</i>x, y" * N,
    "<div class=ad>x, y<i>" * N,
    "<a href=" * N,
    "<p title='" * (N + 1) + ">x",
    "<p>x, y<!--" * N,
])
def test_costs_in_proportion(page):
    tracemalloc.start()
    extract.main_text(page)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
    start = time.perf_counter()
    extract.main_text(page)
    assert time.perf_counter() - start < 5


@pytest.mark.parametrize("page, want", [
    ("<p data-x=it's>Hello one, two.</p><p>It's me, three.</p><p>Four, five.</p>", ["Hello one, two.", "It's me, three.", "Four, five."]),
    ("""<p title="a > b">One, two.</p><p title = 'c > d'>Three, four.</p>""", ["One, two.", "Three, four."]),
    ("""<p title="open>One, two.</p><p>Three, four.</p>""", ["One, two.", "Three, four."]),
    ("<p>One, two.</p><!-- never ends <p>Three, four.</p> and on", ["One, two."]),
])
def test_attributes(page, want):
    assert extract.main_text(page).split("\n\n") == want
