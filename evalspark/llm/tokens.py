"""A public tokenizer's file on the executors, and its answers for single words."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
from pyspark.sql import SparkSession

#: Words that a worker remembers before it starts afresh, and how many it encodes at a time.
MEMO, BATCH = 200_000, 10_000
#: Words whose number of tokens alone a worker remembers.
COUNTS = 400_000
#: What every tokenizer of these drops and never crosses, in any place of a text: ASCII white space.
BLANKS = " \t\n\r\x0b\x0c"


def share(spark: SparkSession, path: str):
    """The file's text as a broadcast: executors need not have the file (a vocabulary has a fixed size)."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


@lru_cache(2)
def load(text: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(text)
    tok.no_truncation()
    tok.no_padding()
    return tok


def unit(tok) -> str:
    """The narrowest integer that holds all ids and one mark."""
    return "<u2" if tok.get_vocab_size() < 0xFFFF else "<u4"


def encode_words(tok, words: list[bytes]):
    """(word, its ids as bytes) one after the other; the library's larger answers are held for ``BATCH`` words only."""
    kind = unit(tok)
    for at in range(0, len(words), BATCH):
        part = words[at : at + BATCH]
        for w, e in zip(part, tok.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)):
            yield w, np.array(e.ids, kind).tobytes()


class Words:
    """Ids of words (as bytes), each encoded once as long as it is remembered."""

    def __init__(self, text: str):
        self.tok, self.memo = load(text), {}

    def learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The memo, holding all of ``words``."""
        new = [w for w in set(words) if w not in self.memo]
        if new:
            if len(self.memo) > MEMO:
                self.memo.clear()
                new = list(set(words))
            self.memo.update(encode_words(self.tok, new))
        return self.memo


class Counts:
    """Numbers of tokens of words (as bytes), each encoded once as long as it is remembered."""

    def __init__(self, text: str):
        self.tok, self.memo = load(text), {}

    def of(self, texts: list[list[bytes]]) -> list[int]:
        """The tokens of each text's words."""
        words = set().union(*texts)
        new = [w for w in words if w not in self.memo]
        if new and len(self.memo) > COUNTS:
            self.memo.clear()
            new = list(words)
        for at in range(0, len(new), BATCH):
            part = new[at : at + BATCH]
            got = self.tok.encode_batch_fast([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)
            self.memo.update(zip(part, map(len, got)))
        n = self.memo.__getitem__
        return [sum(map(n, w)) for w in texts]


@lru_cache(2)
def counts_of(text: str) -> Counts:
    return Counts(text)
