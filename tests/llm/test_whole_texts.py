"""What the operators once left out: each test fails where a part of the input is not read."""

import numpy as np
import pytest

pytest.importorskip("strail.llm.common")

from strail.llm import decontam, toxicity  # noqa: E402


def test_op1_reads_every_character_of_long_tokens():
    net = toxicity.Network(1)
    rng = np.random.default_rng(0)
    for size in (8, 20, 32, 33, 48, 49, 300):
        word = "".join(rng.choice(list("abcdefghij漢字_"), size))
        others = [f"{word[:i]}z{word[i + 1 :]}" for i in range(size)]
        score = toxicity.Scorer(net).score([word, *others])
        assert (score[1:] != score[0]).all(), size
    parts = toxicity.tokens(word)
    assert max(map(len, parts)) <= toxicity.LONGEST and all(any(word[i : i + 16] in p for p in parts) for i in range(size - 15))


def test_op1_n_grams_of_a_word_are_all_pooled():
    w = "incomprehensibilities"
    assert len(toxicity.char_ids(w)) == 2 * len(w)
    rows = toxicity.padded(*toxicity.Network(1).inputs(["ab", w])[1:], np.array([[1, 0]]))
    assert rows.shape == (1, 2, 2 * len(w)) and rows[0, 0].tolist() == toxicity.char_ids(w) and rows[0, 1].tolist() == toxicity.char_ids("ab") + [0] * (2 * len(w) - 4)


def test_op8_short_items_match_as_whole_words(spark):
    bench = spark.createDataFrame([(1, "What is 2+2?"), (2, "cat"), (3, ""), (4, "ends here")], "item_id long, text string")
    rows = [(1, "He asked: what  IS 2+2? Four."), (2, "concatenate the category"), (3, "A Cat, concat"), (4, "it ends heretic"), (5, "It ends here"), (6, None), (7, "cat")]
    got = {tuple(r) for r in decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {(1, 1, 0), (3, 2, 0), (5, 4, 0), (7, 2, 0)}
