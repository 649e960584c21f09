import numpy as np

from crawlscope.llm import ngram_join as J
from crawlscope.llm.common import ascii_words


def test_words_have_equal_hashes_exactly_when_they_are_equal():
    texts = ["", None, " \t ", "a", "A b\tc\x0bD\x0c e\r\nf", "a ab b ba aa a", "x y\x1cz \x85 w\xa0v", "ÀÉ àé \ud800 k", "tail " * 50 + "Tail"]
    words = [w for t in texts for w in ascii_words(t)]
    hashes = [h for t in texts for h in J.word_hashes(t).tolist()]
    assert len(words) == len(hashes) and len(set(zip(words, hashes, strict=True))) == len(set(words)) == len(set(hashes))


def test_places_are_counted_in_the_type_of_the_counts():
    counts = np.zeros(4, np.uint32)
    J.add_places(counts, np.array([1, 1, 3]))
    assert counts.tolist() == [0, 2, 0, 1]
