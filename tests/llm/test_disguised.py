"""Words disguised at their start or end, and with diacritics."""

import pytest

from lodestone.llm.toxicity import Lexicon, features

LEXICON = Lexicon(tuple((f" {w} ", 5.0) for w in ("stupid", "trash", "scum", "idiot")) + ((" cum ", 1.0),))


@pytest.mark.parametrize("word", ["5tupid", "7rash", "$cum", "1diot", "idi07", "idi07!", "1d10t!!", "stupid$$$", "stupid!", "ídiot", "ídiot", "STÜPID", "5tup1d"])
def test_one_word_counts_once(word):
    assert features(f"you {word} there", LEXICON)[0] == pytest.approx(features("you stupid there", LEXICON)[0])


def test_harmless():
    assert features("a 7rash can and 5 cats in 2014!", LEXICON)[0] == 0 == features("4 1 $5 @ !", LEXICON)[0]
