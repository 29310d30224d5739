"""A Python worker holds the words of one operator at a time."""

from quiltlens.llm import ftrl, lsh_forest


def test_an_operator_empties_the_caches_of_the_others():
    texts = [b"some words of a text", b"and of another one"]
    ftrl.features(texts)
    assert len(ftrl._CODES) == 8
    first = lsh_forest.shingle_sets(texts)
    assert not ftrl._CODES and len(lsh_forest._WORDS) == 8
    slots, _ = ftrl.features(texts)
    assert not lsh_forest._WORDS and (ftrl.features(texts)[0] == slots).all()
    assert [s.tolist() for s in lsh_forest.shingle_sets(texts)] == [s.tolist() for s in first]
