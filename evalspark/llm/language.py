"""Language identification with string kernels (operator 2).

A text is the set of its n-grams of one to four letters, blanks at word ends
included (a blended spectrum); the kernel of two texts is the number of
n-grams that both have, divided by the root of the product of their numbers.
Nyström landmarks, a few training texts of each language, turn the kernel into
coordinates, and one kernel ridge regression per language is solved in them.
Texts are scored in batches: landmark presence times text presence is one
matrix product.

N-grams are hashed to ``GRAMS`` places.  A text of more than ``PIECE``
characters is cut into equal pieces of at most that, each a set of its own: one
set of a long text would fill all places and look like any language.  Every
text is scored whole, by the mean of its pieces' margins.  Learnt from
``LANDMARKS`` landmarks and ``FITTED`` rows (those with the smallest hashes) of
each training language; of a long row one piece, any of them by its hash.

A text that is null or has no letter is ``und`` with score 0, as is every text
if nothing can be learnt.  Training rows need a language and a letter.  Repeated
rows are judged alike; null ids count as training rows.
"""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from evalspark.llm.frames import bare, held_out, map_rows

GRAMS = 1 << 14
LANDMARKS, FITTED = 48, 400
RIDGE = 1e-2
#: Characters of a piece at most, and pieces that are scored at a time.
PIECE, BATCH = 2048, 512
_LETTER = regex.compile(r"\p{L}")
_NO_LETTER = re.compile(r"[\W\d_]+")
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def pieces(text: str | None) -> list[np.ndarray]:
    """The text's characters in equal pieces; all but letters is one blank.  Each has the three that follow it, for the n-grams that begin in it."""
    if not text or not _LETTER.search(text):
        return []
    chars = np.frombuffer((" " + _NO_LETTER.sub(" ", text.lower()) + " ").encode("utf-32-le", "replace"), "<u4")
    n = -(-len(chars) // PIECE)
    cuts = [len(chars) * i // n for i in range(n + 1)]
    return [chars[a : b + 3] for a, b in zip(cuts, cuts[1:])]


def _bits(piece: np.ndarray) -> np.ndarray:
    """Which hashed n-grams of one to four characters the piece has."""
    out, piece, h = np.zeros(GRAMS, bool), piece.astype(np.uint64), np.uint64(0)
    for n, factor in enumerate(_FACTORS):
        if len(piece) <= n:
            break
        h = (h[: len(piece) - n] if n else h) * np.uint64(31) + piece[n:] * factor
        mixed = (h ^ (h >> np.uint64(29))) * factor
        out[(mixed >> np.uint64(64 - 14)).astype(np.int64)] = True
    return out


def presence(text: str | None) -> np.ndarray:
    """The same of all pieces of a text."""
    return np.any([np.zeros(GRAMS, bool), *map(_bits, pieces(text))], axis=0)


def _kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    """Normalised numbers of common n-grams of rows of bits; empty rows are 0."""
    a, b = x.astype(np.float32), landmarks.astype(np.float32)
    size = np.sqrt(np.maximum(1, a.sum(axis=1)))[:, None] * np.sqrt(np.maximum(1, b.sum(axis=1)))[None]
    return (a @ b.T) / size


class Model:
    """Landmarks, and for each language the regression's weights on the kernels with them."""

    def __init__(self, languages: list[str], landmarks: np.ndarray, x: np.ndarray, y: np.ndarray):
        self.languages, self.landmarks = languages, landmarks
        values, vectors = np.linalg.eigh(_kernel(landmarks, landmarks).astype(np.float64))
        keep = values > 1e-6 * max(values.max(), 1e-9)
        to = vectors[:, keep] / np.sqrt(values[keep])
        phi = np.column_stack([_kernel(x, landmarks) @ to, np.ones(len(x))])
        targets = np.where(np.arange(len(languages))[None] == y[:, None], 1.0, -1.0)
        # each language weighs the same, however many rows it has
        weight = 1 / np.maximum(1, np.bincount(y, minlength=len(languages)))[y]
        gram = (phi * weight[:, None]).T @ phi + RIDGE * np.eye(phi.shape[1]) / phi.shape[1]
        w = np.linalg.solve(gram, (phi * weight[:, None]).T @ targets)
        self.weights, self.offset = (to @ w[:-1]).astype(np.float32), w[-1].astype(np.float32)

    def margins(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the sum of its pieces' margins, and their number."""
        total, count = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        every = ((i, p) for i, t in enumerate(texts) for p in pieces(t))
        while some := list(islice(every, BATCH)):
            at = np.array([i for i, _ in some])
            np.add.at(total, at, _kernel(np.array([_bits(p) for _, p in some]), self.landmarks) @ self.weights + self.offset)
            np.add.at(count, at, 1)
        return total, count

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        total, count = self.margins(texts)
        margin = total / np.maximum(1, count)[:, None]
        best = margin.argmax(axis=1)
        score = np.clip((margin.max(axis=1) + 1) / 2, 0, 1)
        return [self.languages[b] if c else "und" for b, c in zip(best, count)], [float(x) if c else 0.0 for x, c in zip(score, count)]


def learn(train: DataFrame) -> Model | None:
    """From text and lang; the driver gets ``LANDMARKS + FITTED`` bit sets of each language."""
    first = Window.partitionBy("lang").orderBy("h")
    picked = train.select("lang", F.xxhash64("text").alias("h"), "text").filter(F.col("text").rlike("\\p{L}"))
    # the rank limit works on hashes alone and before they are shuffled; texts are fetched by hash
    chosen = picked.select("lang", "h").distinct().withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= LANDMARKS + FITTED)
    rows = picked.join(F.broadcast(chosen), ["lang", "h"])

    def bits(x):
        parts = [pieces(t) for t in x["text"]]
        own = [np.packbits(_bits(p[h % len(p)]) if p else np.zeros(GRAMS, bool)).tobytes() for p, h in zip(parts, x["h"])]
        return {"lang": x["lang"], "nth": x["nth"], "h": x["h"], "bits": own}

    got = map_rows(rows, bits, "lang string, nth int, h long, bits binary").dropDuplicates(["lang", "h"]).orderBy("lang", "nth").collect()
    if not got:
        return None
    languages = sorted({r["lang"] for r in got})
    x = np.unpackbits(np.array([np.frombuffer(r["bits"], np.uint8) for r in got]), axis=1).astype(bool)
    marks = np.zeros(len(got), bool)
    for lang in languages:
        marks[[i for i, r in enumerate(got) if r["lang"] == lang][:LANDMARKS]] = True
    y = np.array([languages.index(r["lang"]) for r in got])
    return Model(languages, x[marks], x, y)


def identify(docs: DataFrame, training: Column) -> DataFrame:
    """doc_id, lang_pred and score of every row; ``training`` marks rows whose text and lang may be learnt from."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs.filter(training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))))
    kind = dict(docs.dtypes)["doc_id"]

    def rows(x):
        if model.value is None:
            return {"doc_id": x["doc_id"], "lang_pred": ["und"] * len(x["text"]), "score": [0.0] * len(x["text"])}
        lang, score = model.value.predict(x["text"])
        return {"doc_id": x["doc_id"], "lang_pred": lang, "score": score}

    return map_rows(bare(docs), rows, f"doc_id {kind}, lang_pred string, score double", 128)


def identify_held_out(docs: DataFrame, modulus: int = 4) -> DataFrame:
    """``identify``, learnt from the rows that are not held out, with held_out."""
    return identify(docs, ~held_out(modulus)).withColumn("held_out", held_out(modulus))
