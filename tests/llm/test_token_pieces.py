"""The encoder of op9: CPU, what is encoded again, and ids at every kind of place where a text could be cut."""

import random
import time

import numpy as np
import pytest
from tokenizers import Tokenizer

from modelloom.llm import token_output


@pytest.fixture(scope="module")
def model():
    return open(token_output.vocabulary(), encoding="utf-8").read()


class Counted:
    """A tokenizer that counts the letters it is given."""

    def __init__(self, inner, counts):
        self.inner, self.counts = inner, counts

    def encode_batch_fast(self, texts, **options):
        self.counts.append(sum(x.isalpha() for t in texts for x in t))
        return self.inner.encode_batch_fast(texts, **options)


def _words(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(("the", "in", "er", "ou", "st", "an", "ti")) for _ in range(r.randint(2, 5))) + "abcdefghij"[i % 10] for i in range(n)]


def test_known_words_cost_an_eighth(model):
    """A text of known words takes a small part of the library's CPU seconds, with blank lines too: the finding was 483 of 400 seconds a GB."""
    r, words = random.Random(5), _words(60_000, 1)
    lots = [["".join(w + r.choice([" "] * 20 + ["\n\n", "  ", " \t"]) for w in r.choices(words, k=300)) for _ in range(400)] for _ in range(4)]
    encoder, library = token_output.Encoder(model), Tokenizer.from_str(model)
    for lot in lots:
        encoder.encode(lot)

    def least(f):
        took = []
        for lot in lots:
            began = time.thread_time()
            f(lot)
            took.append(time.thread_time() - began)
        return min(took)

    assert least(encoder.encode) < least(lambda lot: [library.encode(t, add_special_tokens=False).ids for t in lot]) / 8


def test_words_met_again_stay(model):
    """Where there is no room for all, frequent words are not encoded again."""
    encoder, counts = token_output.Encoder(model, most_kept=300), []
    encoder.tokenizer, encoder.bare = Counted(encoder.tokenizer, counts), Counted(encoder.bare, counts)
    often, seldom = sorted(set(_words(280, 2))), sorted(set(_words(9_000, 3)))
    for i in range(60):
        counts.clear()
        now = seldom[60 * (i // 2) : 60 * (i // 2) + 60]
        encoder.encode([" ".join(["x", *often]), " ".join(["x", *now])])
        # A space and a line end for each word count as letters in a byte-level vocabulary.
        assert i < 20 or sum(counts) <= sum(len(w) + 2 for w in now)


@pytest.mark.parametrize("most_kept, at_once", [(600_000, 1 << 20), (3, 1 << 20), (50, 16)])
def test_ids_are_the_librarys(model, monkeypatch, most_kept, at_once):
    monkeypatch.setattr(token_output, "AT_ONCE", at_once)
    white = [" ", " ", " ", " ", "  ", "\n", "\n", "\n\n", "\t", "\r", "\0", "\x1c", "\x85", "\xa0", " ", " ", " ", " ", " ", "　", "​"]
    signs = [".", ",", "...", "?|", "#", "'s", "'", "'ll", "5", "3.5", "½", "😀", "_", "-", "×", "÷", "’", "—", "<s>", "́"]
    words = ["a", "b", "the", "é", "À", "ÿ", "Ø", "µ", "š", "е", "語", "HELLO", "thirteenletrs", "fourteenletrss", "ungeheuerlichkeitstheorie", "ä" * 7, "ä" * 8, "x" * 300]
    r, encoder, library = random.Random(7), token_output.Encoder(model, most_kept), Tokenizer.from_str(model)
    for _ in range(300):
        texts = ["".join(r.choice(r.choice((white, signs, words))) for _ in range(r.choice((0, 1, 5, 60)))) for _ in range(r.choice((1, 7)))]
        ids, ends = encoder.encode(texts)
        assert [x.tolist() for x in np.split(ids, ends)[:-1]] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
