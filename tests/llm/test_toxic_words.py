"""Folding and matching of toxic words, held against plain searches."""

import random
import time

import pytest

from meterline.llm.toxicity import Lexicon, fold, hits


@pytest.mark.parametrize("text", [
    "idio7", "1d10t", "İdiot", "ïdïöt", "ｉｄｉｏｔ", "𝐢𝐝𝐢𝐨𝐭", "id​iot", "i­diot", "🅸diot", "іdіоt", "ιdιοt", "ɪᴅɪᴏᴛ", "IDI0T!"])
def test_disguises(text):
    assert fold(text) == " idiot "


def test_endings_and_numbers():
    assert fold("worthle55 a$$ stop! v2019 100 a119") == " worthless ass stop v2019 100 a119 "
    assert fold("") == fold("​") == "  "


def plainly(folded, lexicon):
    """Every place and pattern tried."""
    spared = [(a, a + len(e) + 1) for e in lexicon.exceptions for a in range(len(folded)) if folded.startswith(f" {e} ", a)]
    found = []
    for at in range(len(folded)):
        weights = [w for p, w in lexicon.weights.items() if folded.startswith(" " + p, at)]
        if weights and not any(a <= at < b for a, b in spared):
            found.append((at, max(weights)))
    return found


def test_same_as_plain_search():
    draw = random.Random(7)
    words = ["a", "ab", "abc", "abcd", "b", "ba", "bad", "cab", "dab"]
    for _ in range(300):
        lexicon = Lexicon(
            {draw.choice(words) + draw.choice(["", " "]): draw.random() for _ in range(draw.randint(0, 5))},
            dict.fromkeys(" ".join(draw.choices(words, k=draw.randint(1, 3))) for _ in range(draw.randint(0, 4))))
        folded = fold(" ".join(draw.choices(words, k=draw.randint(0, 40))))
        assert hits(folded, lexicon.automaton()) == plainly(folded, lexicon)


def test_many_exceptions_in_a_text():
    automaton = Lexicon({"bad": 1.0}, {"not bad": None}).automaton()
    start = time.perf_counter()
    assert hits(fold("not bad " * 100_000 + "bad"), automaton) == [(800_000, 1.0)]
    assert time.perf_counter() - start < 5
