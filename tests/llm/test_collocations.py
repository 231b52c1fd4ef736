"""Collocations against plain counting."""

import random
import re
from collections import Counter

import plain
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_llm import ROWS, bag, write

from evalspark.llm import collocations, queries
from evalspark.llm.frames import documents

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mined(rows, top=2000):
    """The rows wanted of (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", plain.lower(text)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in (1, 2, 3):
                for k in range(len(w) - m + 1):
                    f[lang, tuple(w[k : k + m])] += 1
    found = {k: c for k, c in f.items() if len(k[1]) > 1 and c >= 10}
    covered = {(g, w[k : k + 2]) for (g, w), c in found.items() if len(w) == 3 for k in (0, 1) if 100 * c >= 50 * found[g, w[k : k + 2]]}
    rows = []
    for (g, w), a in found.items():
        cuts = [(1000000 * a * a // (f[g, w[:k]] * f[g, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        if (g, w) not in covered:
            rows.append((g, -score, -a, " ".join(w).encode(), f[g, w[:k]], f[g, w[k:]]))
    out, rank = [], Counter()
    for g, s, a, phrase, left, right in sorted(rows):
        rank[g] += 1
        if rank[g] <= top:
            out.append((g, rank[g], phrase.decode(), -a, left, right, n[g], -s))
    return out


def made(path, rows):
    """A table of (lang, text), in several files' worth of row groups."""
    n = len(rows)
    columns = {"doc_id": pa.array(range(n)), "lang": pa.array([x for x, _ in rows], pa.string()), "text": pa.array([t for _, t in rows], pa.string())}
    extra = {c: pa.array(["x"] * n) for c in ("phrase", "f", "n", "words", "rank", "at")}
    pq.write_table(pa.table(columns | extra), f"{path}/documents.parquet", row_group_size=50)
    return str(path)


rnd = random.Random(3)
WORDS = ["the", "The", "of", "new", "york", "city", "é", "É", "日本", "a\xa0b", "\x00", "x" * 300, "q"]


def text(n):
    return "".join(rnd.choice(WORDS) + rnd.choice([" ", " ", " ", "  ", "\t", ". ", "\n", "!"]) for _ in range(n))


HOT = "the most common words of all "
CASES = {
    "random": [(rnd.choice(["en", "fr", None, "und"]), text(rnd.randint(0, 60))) for _ in range(400)] + [("en", None), (None, None), ("en", "")],
    "hot": [("en", HOT * rnd.randint(1, 9)) for _ in range(300)] + [("en", f"the w{rnd.randint(0, 40)} v{rnd.randint(0, 3)}") for _ in range(3000)],
    "ties": [("en", f"a{k} b{k}") for k in range(30) for _ in range(10)] + [("fr", "p q r " * 4)] * 10 + [("de", "z z z z z z z z z z z z")],
    "nine": [("en", "nine times")] * 9 + [("fr", "ten times")] * 10,
}


@pytest.mark.parametrize("case", list(CASES))
def test_collocations(spark, tmp_path, case):
    got = queries.QUERIES["op11_phrase_collocations"](spark, made(tmp_path, CASES[case])).collect()
    assert [r for r in sorted(tuple(r[c] for c in COLUMNS) for r in got)] == sorted(mined(CASES[case]))


def test_awkward_rows(spark, tmp_path):
    path = write(tmp_path, ROWS * 3, [], [])
    rows = [(r["lang"], r["text"]) for r in documents(spark, path).collect()]
    got = queries.QUERIES["op11_phrase_collocations"](spark, path).collect()
    assert bag(tuple(r[c] for c in COLUMNS) for r in got) == bag(mined(rows)) and got


def test_top_and_partitions(spark, tmp_path):
    docs = documents(spark, made(tmp_path, CASES["hot"])).repartition(9)
    was = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 61)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # runs of one word cross many partitions
        got = collocations.mine(docs, top=25).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was[1])
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == sorted(mined(CASES["hot"], 25))


@pytest.mark.parametrize("size", [20, 50, 333, 10**6])
@pytest.mark.parametrize("order", [1, 2, 3])
def test_slices_of_a_long_text_lose_nothing(monkeypatch, size, order):
    monkeypatch.setattr(collocations, "SLICE", size)
    for whole in (text(400), "w " * 200 + "y" * 100 + " z v " * 50, "no-blank-at-all" * 40, " " * 300 + "a b c" + " " * 300, "a. " * 99):
        raw = whole.encode().translate(collocations._MAP)

        def count(parts):
            f = Counter()
            for p in parts:
                for piece in p.split(b"\n"):
                    w = [x for x in piece.split(b" ") if x]
                    f.update(tuple(w[k : k + order]) for k in range(len(w) - order + 1))
            return f

        assert count(collocations._slices(raw, order - 1)) == count([raw])


def test_very_long_text(spark, tmp_path):
    rows = [("en", "many words in one long text " * 120_000), ("en", "z" * 3_000_000)]
    got = queries.QUERIES["op11_phrase_collocations"](spark, made(tmp_path, rows)).collect()
    assert sorted(tuple(r[c] for c in COLUMNS) for r in got) == sorted(mined(rows))


def test_scores_are_exact(spark):
    a, left, right = 99_999_999_999_999, 99_999_999_999_999, 99_999_999_999_998
    rows = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert rows.select(collocations._score("l", "r").alias("s")).first()["s"] == 1000000 * a * a // (left * right)
