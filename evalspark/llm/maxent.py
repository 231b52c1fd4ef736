"""Language-model scores by a hashed maximum-entropy model (operator 1).

Tokens are lower-cased (A-Z) words and one end per text.  All training tokens
are counted: every input partition (block) sends its distinct tokens to the
buckets of the count table and gets the totals back, so that no vocabulary is
held whole anywhere.  The ``VOCABULARY`` most frequent tokens are the model's
words, 64 of similar frequency to a class; all other tokens form one more
class, within which a token has its share of the counts (one more for each,
and one for all unseen ones).

The model gives P(class | history) * P(word | class, history), both softmax of
a prior and of hashed weights of the previous word, the previous two words and
the word before the last (a skip).  Training starts from the counts, which is
the base model, and goes through all training texts once in ``ROUNDS`` rounds:
every task makes Adagrad updates on its texts from the same weights, and the
changes are averaged per feature over the tasks that touched it.  Weights have a
fixed size and are broadcast.  Documents travel once as numbers of frequent
tokens with holes; scores are made in batches where the holes are filled.

Null texts are empty: one end.  Null ids count as training rows.  Repeated rows
count and are scored each.  Without training texts no token is known and each
has probability one of one (N = V = 0).
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from evalspark.llm.bpe import pack, unpack
from evalspark.llm.frames import bare, map_rows, materialize

#: Frequent tokens that are broadcast with their counts; those of the model.
HEAD, VOCABULARY, PER_CLASS = 60_000, 4096, 64
CLASSES = VOCABULARY // PER_CLASS + 1
#: Hashed features of the classes and of the words within classes.
ROWS = 1 << 13
ROUNDS, BATCH, STEP = 3, 16_384, 0.15
HELD, BUCKETS, SLICE = 200_000, 8192, 64
#: The end of a text; no word has a blank.
END = b"\n"
_HOLE, _START = 0xFFFF, VOCABULARY + 1
_OTHER = VOCABULARY


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split()


def _join(words: list[bytes]) -> bytes:
    return pack(b" ".join(words))


def _split(data: bytes) -> list[bytes]:
    return unpack(data).split(b" ")


def _asked(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, tokens, training counts): the distinct tokens of each block."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, Counter()

        def out():
            at = {}
            for w in held:
                at.setdefault(crc32(w) % buckets, []).append(w)
            rows = [(b, block, _join(ws), pack(np.array([held[w] for w in ws], "<u4").tobytes())) for b, ws in at.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "block", "words", "counts"])

        for batch in batches:
            for text, out_of, block in zip(*(c.to_pylist() for c in batch.columns)):
                own = tokens(text)
                own.append(END)
                if out_of:
                    for w in own:
                        held.setdefault(w, 0)
                else:
                    held.update(own)
                if len(held) > HELD:
                    yield out()
        if held:
            yield out()

    return docs.select("text", "held_out", "block").mapInArrow(each, "bucket int, block int, words binary, counts binary")


def _answered(asked: DataFrame, buckets: int) -> DataFrame:
    """Per question (block, words, total counts), and per bucket its most frequent words, tokens (n) and distinct tokens (v)."""
    top = 2 * HEAD // buckets + 50
    names = ["block", "words", "counts", "n", "v"]

    def answer(rows):
        total: dict[bytes, int] = {}
        for words, counts in rows:
            for w, c in zip(_split(words[1]), np.frombuffer(unpack(counts), "<u4").tolist()):
                total[w] = total.get(w, 0) + c
        out = [(words[0], words[1], pack(np.array([total[w] for w in _split(words[1])], "<i8").tobytes()), 0, 0) for words, _ in rows]
        best = heapq.nsmallest(top, ((-c, w) for w, c in total.items() if c))
        out.append((None, _join([w for _, w in best]), pack(np.array([-c for c, _ in best], "<i8").tobytes()), sum(total.values()), sum(c > 0 for c in total.values())))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()))], names=names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for bucket, block, words, counts in (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))):
            if bucket != now and rows:
                yield answer(rows)
                rows = []
            now = bucket
            rows.append(((block, words), counts))
        if rows:
            yield answer(rows)

    placed = asked.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return placed.mapInArrow(each, "block int, words binary, counts binary, n long, v long")


class Counts:
    """The head with counts, and the sums: N and V of all tokens and of those outside the model's words."""

    def __init__(self, head: list[tuple[bytes, int]], n: int, v: int):
        self.code = {w: i for i, (w, _) in enumerate(head)}
        self.count = np.array([c for _, c in head] or [0], np.int64)
        self.n, self.v = n, v
        own = self.count[:VOCABULARY]
        self.n_other, self.v_other = n - int(own.sum()), v - int((own > 0).sum())

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.n + self.v + 1))

    def other(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.n_other + self.v_other + 1))


class Model:
    """Weights, all of fixed size."""

    def __init__(self, counts: Counts):
        own = np.zeros(VOCABULARY)
        n = min(VOCABULARY, len(counts.count))
        own[:n] = counts.count[:n]
        words = own.reshape(-1, PER_CLASS)
        # words that no one saw cannot be met; a class without words keeps next to nothing
        self.word_prior = np.log(np.maximum(words, 1e-6) / np.maximum(words.sum(axis=1, keepdims=True), 1e-6)).astype(np.float32)
        sizes = np.concatenate([words.sum(axis=1), [counts.n_other + counts.v_other + 1]])
        self.class_prior = np.log(np.maximum(sizes, 1e-6) / sizes.sum()).astype(np.float32)
        self.by_class = np.zeros((ROWS, CLASSES), np.float32)
        self.by_word = np.zeros((ROWS, PER_CLASS), np.float32)

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        return self.by_class, self.by_word


def history(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Target symbols, and for each the three hashed features of what precedes it in its text."""
    seq = np.where(codes < VOCABULARY, codes, _OTHER).astype(np.int64)
    one, two = np.roll(seq, 1), np.roll(seq, 2)
    one[starts] = _START
    two[starts] = _START
    second = starts[:-1][np.diff(starts) > 1] + 1 if len(starts) else starts
    second = np.concatenate([second, starts[-1:][starts[-1:] + 1 < len(seq)] + 1])
    two[second] = _START
    mix = lambda a, salt: (a * 0x9E3779B1 + salt * 0x85EBCA6B) & 0xFFFFFFFF
    return seq, np.stack([mix(one, 1), mix(one * (_START + 1) + two + 7, 2), mix(two, 3)])


def _softmax(x: np.ndarray) -> np.ndarray:
    """Of rows of logits, which beyond +-60 count as that."""
    np.clip(x, -60, 60, out=x)
    np.exp(x, out=x)
    x *= (1 / (x @ np.ones(x.shape[1], x.dtype)))[:, None]
    return x


def _added(prior: np.ndarray, table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The prior plus the table's rows of each feature."""
    out = np.take(table, rows[0], axis=0)
    for r in rows[1:]:
        out += np.take(table, r, axis=0)
    out += prior
    return out


def _rows(features: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
    h = (features ^ (features >> 15)) * 0x2C1B3C6D + salt * 0xC2B2AE35
    return (h ^ (h >> 17)) & (ROWS - 1)


def _parts(m: Model, seq: np.ndarray, features: np.ndarray):
    """P(class) and P(word of its class) for every symbol, and the rows they come from."""
    own = seq // PER_CLASS
    rows = _rows(features)
    p = _softmax(_added(m.class_prior, m.by_class, rows))
    known = np.flatnonzero(seq < VOCABULARY)
    word_rows = _rows(features[:, known], own[known] + 1)
    q = _softmax(_added(m.word_prior[own[known]], m.by_word, word_rows))
    return own, rows, p, known, word_rows, q


def score_symbols(m: Model, seq: np.ndarray, features: np.ndarray) -> np.ndarray:
    """log10 of each symbol's probability; that of a token within the last class is not part of it."""
    out = np.empty(len(seq))
    for at in range(0, len(seq), BATCH):
        s = seq[at : at + BATCH]
        own, _, p, known, _, q = _parts(m, s, features[:, at : at + BATCH])
        got = np.log10(np.maximum(p[np.arange(len(s)), own], 1e-30))
        got[known] += np.log10(np.maximum(q[np.arange(len(known)), s[known] % PER_CLASS], 1e-30))
        out[at : at + BATCH] = got
    return out


def _update(w: np.ndarray, squares: np.ndarray, rows: np.ndarray, g: np.ndarray) -> None:
    """One Adagrad step for each feature on the rows of the gradients; equal rows are summed first."""
    for own in rows:
        order = np.argsort(own.astype(np.int16), kind="stable")
        at = own[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        sums = _sums(np.take(g, order, axis=0), first)
        at = at[first]
        scale = squares[at] + np.square(sums)
        squares[at] = scale
        np.sqrt(scale, out=scale)
        sums /= scale
        sums *= STEP
        w[at] -= sums


def _sums(g: np.ndarray, first: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Sums of the runs of rows that begin at ``first``: short runs side by side, the rest of long ones one by one."""
    end = np.append(first[1:], len(g))
    out = g[first]
    for k in range(1, rounds):
        more = np.flatnonzero(end - first > k)
        out[more] += g[first[more] + k]
    for i in np.flatnonzero(end - first > rounds):
        out[i] += g[first[i] + rounds : end[i]].sum(axis=0)
    return out


class Trainer:
    """A task's own copy of the weights."""

    def __init__(self, m: Model):
        self.before, self.m = m, Model.__new__(Model)
        self.m.__dict__.update(m.__dict__, by_class=m.by_class.copy(), by_word=m.by_word.copy())
        self.squares = tuple(np.ones_like(a) for a in m.arrays())

    def learn(self, seq: np.ndarray, features: np.ndarray) -> None:
        for at in range(0, len(seq), BATCH):
            s = seq[at : at + BATCH]
            own, rows, p, known, word_rows, q = _parts(self.m, s, features[:, at : at + BATCH])
            p[np.arange(len(s)), own] -= 1
            _update(self.m.by_class, self.squares[0], rows, p)
            if len(known):
                q[np.arange(len(known)), s[known] % PER_CLASS] -= 1
                _update(self.m.by_word, self.squares[1], word_rows, q)

    def changes(self) -> list[tuple[int, bytes, bytes]]:
        """(part, half-precision changes, touched rows) of both tables in eight parts each."""
        out = []
        for i, (new, old) in enumerate(zip(self.m.arrays(), self.before.arrays())):
            delta = (new - old).astype(np.float16)
            for j, part in enumerate(np.split(delta, 8)):
                out.append((8 * i + j, pack(part.tobytes()), (part != 0).any(axis=1).tobytes()))
        return out


def _sequences(row: tuple, trained: bool) -> tuple[np.ndarray, np.ndarray]:
    """Codes and text starts of a slice's documents, all or only the training ones."""
    held, lengths, codes = row
    n = np.frombuffer(unpack(lengths), "<u4").astype(np.int64)
    c = np.frombuffer(unpack(codes), "<u2")
    if trained:
        keep = ~np.array(held, bool)
        c, n = c[np.repeat(keep, n)], n[keep]
    return c, (np.cumsum(n) - n)


def train(coded: DataFrame, counts: Counts) -> Model:
    """All training texts once, in rounds."""
    m, sc = Model(counts), coded.sparkSession.sparkContext
    for r in range(ROUNDS):
        now = sc.broadcast(m)

        def local(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            t = Trainer(now.value)
            for batch in batches:
                for at in range(batch.num_rows):
                    codes, starts = _sequences(tuple(c[at].as_py() for c in batch.columns), True)
                    if len(codes):
                        t.learn(*history(codes, starts))
            out = t.changes()
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary()))], names=["part", "delta", "touched"])

        def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for part, delta, touched in (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))):
                mask = np.frombuffer(touched, bool)
                d = np.frombuffer(unpack(delta), np.float16).reshape(len(mask), -1).astype(np.float32)
                own = sums.setdefault(part, [np.zeros_like(d), np.zeros(len(mask), np.float32)])
                own[0] += d
                own[1] += mask
            for part, (d, n) in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([(d / np.maximum(1, n)[:, None]).tobytes()], pa.binary())], names=["part", "delta"])

        share = coded.filter(F.pmod(F.xxhash64("ids"), F.lit(ROUNDS)) == r).select("held", "lengths", "codes").coalesce(sc.defaultParallelism)
        changes = share.mapInArrow(local, "part int, delta binary, touched binary").repartition("part").mapInArrow(average, "part int, delta binary")
        for part, delta in changes.collect():  # 16 rows of fixed size
            table = m.arrays()[part // 8]
            own = np.split(table, 8)[part % 8]
            own += np.frombuffer(delta, np.float32).reshape(own.shape)
    return m


def score(docs: DataFrame, held: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; rows that are not ``held`` out are learnt from."""
    from pyspark.sql.pandas.types import to_arrow_type

    sc = docs.sparkSession.sparkContext
    kind = docs.schema["doc_id"].dataType
    rows = bare(docs).withColumns({"held_out": held, "block": F.spark_partition_id()})
    # as many places as the input has partitions, whatever the session's setting
    blocks = max(1, docs.rdd.getNumPartitions())
    buckets = min(BUCKETS, blocks)
    answers = materialize(_answered(_asked(rows, buckets), buckets), "token-counts")
    n, v = answers.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    best = [x for r in answers.filter("block IS NULL").select("words", "counts").collect() for x in zip(_split(r["words"]), np.frombuffer(unpack(r["counts"]), "<i8").tolist())]
    ends = [x for x in best if x[0] == END] or [(END, 0)]
    best = [x for x in best if x[0] not in (END, b"")]
    counts = Counts(ends + heapq.nsmallest(HEAD - 1, best, key=lambda x: (-x[1], x[0])), n, v)
    shared = sc.broadcast(counts)

    def code(x):
        known, codes, lengths, rare = shared.value.code, [], [], []
        for text in x["text"]:
            own = tokens(text) + [END]
            codes.append(np.fromiter(map(known.get, own, repeat(_HOLE)), "<u2", len(own)).tobytes())
            lengths.append(len(own))
            rare += [w for w in own if w not in known]
        arrays = (pack(np.array(lengths, "<u4").tobytes()), pack(b"".join(codes)), _join(rare))
        return {"block": x["block"][:1], "ids": [x["doc_id"]], "held": [x["held_out"]], **{k: [a] for k, a in zip(("lengths", "codes", "words"), arrays)}}

    schema = f"block int, ids array<{kind.simpleString()}>, held array<boolean>, lengths binary, codes binary, words binary"
    coded = materialize(map_rows(rows, code, schema, SLICE), "coded")
    trained = sc.broadcast(train(coded, counts))
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    out_types = [to_arrow_type(kind), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, table, c = None, {}, shared.value
        for batch in (b.slice(at, 1) for b in batches for at in range(b.num_rows)):
            block, is_docs, ids, held, lengths, codes, words, totals = (x[0].as_py() for x in batch.columns)
            if block != now:
                now, table = block, {}
            words = _split(words)
            if not is_docs:
                table.update((w, t) for w, t in zip(words, np.frombuffer(unpack(totals), "<i8").tolist()) if w not in c.code)
                continue
            codes, starts = _sequences((held, lengths, codes), False)
            holes = codes == _HOLE
            count = c.count[np.where(holes, 0, codes)]
            count[holes] = [table[w] for w in words] if holes.any() else []
            seq, features = history(codes, starts)
            logs = score_symbols(trained.value, seq, features)
            logs = np.where(seq == _OTHER, logs + c.other(count), logs)
            length = np.diff(np.append(starts, len(codes)))
            sums = [np.add.reduceat(a, starts) for a in ((count > 0).astype(np.int64), c.base(count), logs)]
            columns = [ids, held, length, sums[0], np.full(len(ids), c.n), sums[1], sums[2]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, out_types)], names=names)

    own = coded.withColumns({"is_docs": F.lit(True), "counts": F.lit(None).cast("binary")})
    asked = answers.filter("block IS NOT NULL").select("block", "words", "counts").withColumn("is_docs", F.lit(False))
    both = own.unionByName(asked, allowMissingColumns=True).select("block", "is_docs", "ids", "held", "lengths", "codes", "words", "counts")
    schema = f"doc_id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return both.repartition(blocks, "block").sortWithinPartitions("block", "is_docs").mapInArrow(fill, schema)
