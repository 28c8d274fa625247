"""Long words in the lattice (8) and the automaton (3): the same results as by the other path, and a megabyte in seconds."""
import time

import numpy as np
import pytest

from vistalake.llm import bpe, lm

BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


@pytest.fixture(scope="module")
def lattice():
    pieces = lm.vocabulary_pieces(bpe.default_vocabulary("piece_bpe_32k.model"))
    return lm.Lattice(pieces, lm.first_guess(len(pieces)))


def word(n, seed=1, letters=BASE64):
    return "".join(np.random.default_rng(seed).choice(list(letters), n))


def test_one_word_equals_many(lattice, monkeypatch):
    words = ["a", "the", "café", "漢字", "😀x", word(30), word(90, 2), "a" * 200, word(300, 3, "abcäß漢 ".replace(" ", ""))]
    counts = np.arange(1, len(words) + 1)
    alone = lattice.log_likelihood(words), lattice.expected(words, counts)
    monkeypatch.setattr(lm, "FEW_WORDS", 0)
    together = lattice.log_likelihood(words), lattice.expected(words, counts)
    assert np.allclose(alone[0], together[0], rtol=1e-12) and np.allclose(alone[1], together[1], rtol=1e-9, atol=1e-12)
    monkeypatch.setattr(lm, "FEW_WORDS", 64)
    monkeypatch.setattr(lm, "_NODES", 7)
    assert np.allclose(lattice.log_likelihood(words), alone[0], rtol=1e-12) and np.allclose(lattice.expected(words, counts), alone[1], rtol=1e-9, atol=1e-12)


def test_megabyte_word_in_the_lattice(lattice):
    began = time.time()
    found = lattice.log_likelihood([word(1 << 20)])
    uses = lattice.expected([word(1 << 20)], np.array([1]))
    assert np.isfinite(found).all() and found[0] < -1e6 and uses.sum() > 1 << 18 and time.time() - began < 90


def test_long_words_equal_the_library(spark):
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    texts = [word(5000), word(700, 4, "abcdefgh"), "a" * 3000, word(400, 5, "äöüß漢字"), "=" * 1000 + word(200, 6)]
    rows = bpe.bpe_encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in rows}
    assert got == {k: library.encode(t, add_special_tokens=False).ids for k, t in enumerate(texts)}


def test_megabyte_word_in_the_automaton():
    automaton, data = bpe.Automaton(bpe.default_vocabulary()), np.frombuffer(word(1 << 20, 7, BASE64[:52]).encode(), np.uint8)
    began = time.time()
    ids, counts = automaton.encode(data, np.array([0]), np.array([len(data)]))
    assert counts[0] == len(ids) > 1 << 17 and time.time() - began < 90
