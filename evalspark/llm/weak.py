"""Quality classifier from weak labels (operator 8).

Two judgements, ``junk`` and ``toxic``, each with its overlapping heuristic
labellers that say yes, no or nothing.  Expectation-maximisation over the
counts of all documents' vote patterns (at most 3 ** labellers) estimates how
often each labeller says what of either class, without any truth.  The
posterior labels train a hashed linear scorer, by rounds of local updates that
are averaged, and the scorer judges every whole text.

Two of the toxic labellers look up words and word beginnings that are learnt
from a bounded sample of labelled rows: the ``SAMPLE`` labelled ids with the
smallest hash.  The scorer is fitted on the same rows' texts and posterior
labels; all other steps cover all rows.

Null texts are empty, are junk and not toxic.  Rows with a null id are judged
too, labels with a null id are ignored.  A document with several labels counts
as toxic if one says so.  Without labels the learnt labellers say nothing.
Repeated rows are judged alike.
"""

from __future__ import annotations

import math
import re
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, functions as F

from evalspark.llm.frames import bare, map_rows, materialize
from evalspark.llm.measures import COUNTS, measure

#: Labelled rows that words are learnt from and the scorer is fitted on.
SAMPLE = 20_000
#: Learnt words and beginnings at most, their least number of toxic documents and least odds.
LEXICON, LEAST, ODDS = 2000, 8, 30.0
#: Features of the scorer, local passes and averaging rounds.
FEATURES, ROUNDS, TASKS = 1 << 16, 6, 8
KIND = "<u2"
#: Probability from which a judgement is made.
DECIDE = 0.8
#: Words that insult in everyday English.
INSULTS = frozenset("idiot moron loser scum trash stupid worthless pathetic disgusting clown dumb fool jerk ugly".split())
YES, NO, NOTHING = 1, 0, 2
_LETTERS = re.compile(r"[^\W\d_]+")


def terms(text: str) -> set[str]:
    """Distinct words, and the first four and five letters of longer ones after ``^``."""
    words = set(_LETTERS.findall(text.lower()))
    return words | {"^" + w[:n] for w in words for n in (4, 5) if len(w) > n}


def votes(text: str, lexicon: frozenset[str], found: set[str] | None = None) -> tuple[list[int], list[int]]:
    """What the labellers of junk and of toxic say."""
    m = dict(zip(COUNTS, measure(text)))
    n = max(1, m["n_words"])
    shares = {
        "repeats": (m["n_repeat_words"] / n, 0.25),
        "symbols": (m["n_symbols"] / n, 0.15),
        "caps": (m["n_caps"] / n, 0.5),
        "exclaims": (m["n_exclaims"] / n, 0.3),
        "few words": (1 - m["n_distinct"] / n if n > 30 else 0.0, 0.8),
        "lines": (m["n_dup_lines"] / max(1, m["n_lines"]), 0.5),
        "short": (float(m["n_words"] < 3), 0.5),
    }
    # each rule knows one kind of junk; that a text is fine is said only where all are far from it
    calm = all(value <= 0.4 * limit for value, limit in shares.values())
    junk = [YES if value > limit else NOTHING for value, limit in shares.values()] + [NO if calm else NOTHING]
    found = terms(text) if found is None else found
    insults, learnt = len(found & INSULTS), found & lexicon
    starts = sum(t[0] == "^" for t in learnt)
    several = lambda n: YES if n > 1 else NOTHING if n else NO
    toxic = [YES if insults else NOTHING, several(insults), *((several(len(learnt) - starts), several(starts)) if lexicon else (NOTHING, NOTHING))]
    return junk, toxic


def _pattern(v: list[int]) -> int:
    return sum(x * 3**i for i, x in enumerate(v))


def estimate(counts: dict[int, int], labellers: int, prior: float = 0.15, rounds: int = 200) -> tuple[dict[int, float], np.ndarray]:
    """Posterior of yes for each vote pattern, and P(vote | class) of each labeller, by EM from mildly right labellers."""
    if not counts:
        return {}, np.zeros((2, labellers, 3))
    patterns = np.array(sorted(counts))
    n = np.array([counts[p] for p in patterns], float)
    v = np.stack([patterns // 3**i % 3 for i in range(labellers)], axis=1)
    said = np.stack([v == x for x in (NO, YES, NOTHING)], axis=2).astype(float)
    yes, no = (said[:, :, i].sum(axis=1) for i in (1, 0))
    post = np.where(yes > 0, 0.5 + 0.45 * yes / np.maximum(1, yes + no), 0.05)
    for _ in range(rounds):
        table = np.empty((2, labellers, 3))
        for c, q in enumerate((1 - post, post)):
            w = (n * q)[:, None, None]
            table[c] = ((said * w).sum(axis=0) + 0.5) / ((n * q).sum() + 1.5)
        prior = ((n * post).sum() + 1) / (n.sum() + 2)
        like = [(said * np.log(table[c])[None]).sum(axis=(1, 2)) for c in (0, 1)]
        new = 1 / (1 + np.exp(np.clip(like[0] + math.log(1 - prior) - like[1] - math.log(prior), -500, 500)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return dict(zip(patterns.tolist(), post.tolist())), table


def _sampled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts of the labelled sample; its ids are broadcast, ``SAMPLE`` at most."""
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.coalesce("toxic", F.lit(0))).alias("toxic"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    return bare(docs).join(F.broadcast(few), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))


def learn_lexicon(sample: DataFrame) -> frozenset[str]:
    """Words and beginnings that toxic documents have far more often."""
    from collections import Counter

    def count(x):
        n = {0: Counter(), 1: Counter()}
        for text, toxic in zip(x["text"], x["toxic"]):
            n[int(toxic == 1)].update(terms(text))
        every = list(n[0] | n[1])
        return {"term": every, "clean": [n[0][t] for t in every], "bad": [n[1][t] for t in every]}

    sizes = {r["toxic"] == 1: r["count"] for r in sample.groupBy((F.col("toxic") == 1).alias("toxic")).count().collect()}
    clean, bad = sizes.get(False, 0), sizes.get(True, 0)
    if not bad or not clean:
        return frozenset()
    table = map_rows(sample, count, "term string, clean long, bad long", 4096).groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("bad").alias("bad"))
    odds = (F.col("bad") / bad) / ((F.col("clean") + 0.5) / clean)
    best = table.filter((F.col("bad") >= LEAST) & (odds >= ODDS)).orderBy(F.desc("bad"), "term").limit(LEXICON)
    return frozenset(r["term"] for r in best.collect())


def features(found: set[str], v: list[int]) -> np.ndarray:
    """Hashed terms, labellers' votes and a constant."""
    at = {crc32(t.encode()) % (FEATURES - 128) for t in found}
    return np.array([*at, *(FEATURES - 128 + 3 * i + x for i, x in enumerate(v)), FEATURES - 1], KIND)


def _values(x: np.ndarray) -> np.ndarray:
    """A document's terms weigh less the more there are; votes and the constant weigh one."""
    term = x < FEATURES - 128
    return np.where(term, 4 / np.sqrt(16 + term.sum()), 1).astype(np.float32)


def _probability(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[:, x] @ _values(x), -30, 30)))


def fit(rows: DataFrame) -> np.ndarray:
    """Weights of both judgements from rows (x: features as bytes, junk, toxic: posteriors), averaged over tasks after each round."""
    rows = materialize(rows.repartition(TASKS), "weak-training")
    weights = np.zeros((2, FEATURES), np.float32)
    for _ in range(ROUNDS):
        held = rows.sparkSession.sparkContext.broadcast(weights)

        def local(x, held=held):
            w, g2 = held.value.copy(), np.full((2, FEATURES), 1.0, np.float32)
            for ids, junk, toxic in zip(x["x"], x["junk"], x["toxic"]):
                at = np.frombuffer(ids, KIND)
                g = (_probability(w, at) - np.array([junk, toxic])).astype(np.float32)
                g = g[:, None] * _values(at)
                g2[:, at] += g * g
                w[:, at] -= 0.1 * g / np.sqrt(g2[:, at])
            return {"w": [w.tobytes()], "n": [len(x["x"])]}

        parts = map_rows(rows, local, "w binary, n long", SAMPLE).collect()  # one for each Arrow batch of at most SAMPLE rows
        total = sum(p["n"] for p in parts)
        if not total:
            break
        weights = sum(np.frombuffer(p["w"], np.float32).reshape(2, FEATURES) * (p["n"] / total) for p in parts).astype(np.float32)
    return weights


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the weak posteriors and the scorer's probabilities of junk and toxic, the two decisions, and kept."""
    sample = _sampled(docs, labels)
    sc = docs.sparkSession.sparkContext
    lexicon = sc.broadcast(learn_lexicon(sample))
    kind = dict(docs.dtypes)["doc_id"]

    def look(x):
        out = {"doc_id": x["doc_id"], "x": [], "j": [], "t": []}
        for t in x["text"]:
            found = terms(t)
            j, v = votes(t, lexicon.value, found)
            for name, value in zip(("x", "j", "t"), (features(found, j + v).tobytes(), _pattern(j), _pattern(v))):
                out[name].append(value)
        return out

    # texts are read once; their features, at most two bytes for each place, take their place
    seen = materialize(map_rows(bare(docs), look, f"doc_id {kind}, x binary, j int, t int"), "weak-features")
    counted = seen.groupBy("j", "t").count().collect()  # at most 3 ** 12 patterns
    posts = []
    for name, labellers in (("j", 8), ("t", 4)):
        n: dict[int, int] = {}
        for r in counted:
            n[r[name]] = n.get(r[name], 0) + r["count"]
        posts.append(estimate(n, labellers)[0])
    posts = sc.broadcast(posts)

    def label(x):
        out = {"x": [], "junk": [], "toxic": []}
        for t in x["text"]:
            found = terms(t)
            j, v = votes(t, lexicon.value, found)
            out["x"].append(features(found, j + v).tobytes())
            out["junk"].append(posts.value[0][_pattern(j)])
            out["toxic"].append(posts.value[1][_pattern(v)])
        return out

    weights = sc.broadcast(fit(map_rows(sample, label, "x binary, junk double, toxic double")))

    def score(x):
        p = [_probability(weights.value, np.frombuffer(ids, KIND)) for ids in x["x"]]
        weak = [[posts.value[i][v] for v in x[name]] for i, name in enumerate("jt")]
        return {"doc_id": x["doc_id"], "junk_weak": weak[0], "toxic_weak": weak[1], "junk_score": [float(y[0]) for y in p], "toxic_score": [float(y[1]) for y in p]}

    scored = map_rows(seen, score, f"doc_id {kind}, junk_weak double, toxic_weak double, junk_score double, toxic_score double")
    scored = scored.withColumns({"junk": F.col("junk_score") >= DECIDE, "toxic": F.col("toxic_score") >= DECIDE})
    return scored.withColumn("kept", ~(F.col("junk") | F.col("toxic")))
