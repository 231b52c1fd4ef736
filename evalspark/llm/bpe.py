"""BPE encoding and decoding through a distinct-word table (operator 5).

Words are what ASCII white space separates; such white space is dropped by the
tokenizer and no token, normalisation or pattern crosses it, so a text's ids
are its words' ids one after the other.  Documents stay in their input
partitions, the blocks.  Frequent words (``HEAD`` at most, chosen by a count
over a share of the texts: a choice of route, not of result) are encoded once
and broadcast.  For all others each block sends its distinct words to the
buckets of the word table, where each is encoded once, and gets the ids back.
Meanwhile documents travel to their block's place as head ids with holes; the
holes are filled by position.  Decoding looks ids up in the id-to-piece table,
whose size is the vocabulary's.

Null texts are empty: no tokens, empty decoded text.  Repeated rows are rows of
their own.  Texts and words of any length are encoded whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from zstandard import ZstdCompressor, ZstdDecompressor

from evalspark.llm.frames import bare, map_rows, release
from evalspark.llm.tokens import Words, encode_words, load, share, unit

#: Frequent words that are broadcast, and their longest length in bytes.
HEAD, HEAD_BYTES = 1 << 17, 48
#: One of so many documents is counted to choose them.
SHARE = 16
#: Distinct words a task holds before it hands them on.
HELD = 200_000
#: Documents whose ids travel in one row.
SLICE = 64
#: Buckets of the word table at most.
BUCKETS = 8192


def head_words(docs: DataFrame) -> list[bytes]:
    """The most frequent words of a fixed share of the documents."""

    def count(x):
        c = Counter(w for t in x["text"] for w in t.encode("utf-8", "replace").split() if len(w) <= HEAD_BYTES)
        often = [w for w, n in c.items() if n > 1]
        return {"word": often, "n": [c[w] for w in often]}

    part = bare(docs).filter(F.pmod(F.xxhash64("doc_id"), F.lit(SHARE)) == 0)
    counts = map_rows(part, count, "word binary, n long", 4096).groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r["word"]) for r in counts.orderBy(F.desc("n"), "word").limit(HEAD).collect()]


def pack(data: bytes) -> bytes:
    return ZstdCompressor(level=1).compress(data)


def unpack(data: bytes) -> bytes:
    return ZstdDecompressor().decompress(data)


def _numbered(docs: DataFrame) -> DataFrame:
    return bare(docs).withColumn("block", F.spark_partition_id())


def _rare(docs: DataFrame, head, buckets: int) -> DataFrame:
    """(block, bucket, words joined by blanks): the words of each block that are not in the head."""
    schema = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("words", pa.binary())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, block, held = head.value, None, set()

        def out():
            at = {}
            for w in held:
                at.setdefault(crc32(w) % buckets, []).append(w)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([block] * len(at), pa.int32()), pa.array(list(at), pa.int32()), pa.array([pack(b" ".join(sorted(x))) for x in at.values()], pa.binary())], schema=schema)

        for batch in batches:
            if batch.num_rows:
                block = batch.column(1)[0].as_py()
            for text in batch.column(0).to_pylist():
                held.update(w for w in text.encode("utf-8", "replace").split() if w not in known)
                if len(held) > HELD:
                    yield out()
        if held:
            yield out()
        release()

    return _numbered(docs).select("text", "block").mapInArrow(each, "block int, bucket int, words binary")


def _table(rare: DataFrame, file, buckets: int) -> DataFrame:
    """Each bucket's words encoded once: (block, words, bytes of each word's ids, ids)."""

    held: list[Words] = []  # of one task

    def rows(x):
        if not held:
            held.append(Words(file.value))
        table, lengths, ids = held[0], [], []
        for packed in x["words"]:
            words = unpack(packed).split(b" ")
            memo = table.learn(words)
            got = [memo[w] for w in words]
            lengths.append(pack(np.array([len(g) for g in got], "<u4").tobytes()))
            ids.append(pack(b"".join(got)))
        return {"block": x["block"], "words": x["words"], "lengths": lengths, "ids": ids}

    placed = rare.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return map_rows(placed, rows, "block int, words binary, lengths binary, ids binary", 8)


def encode(docs: DataFrame, path: str, decoded: bool = False) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers behind each other) of every row.

    With ``decoded`` what ``decode`` makes of the ids too, in the same tasks.
    """
    spark = docs.sparkSession
    pieces = _pieces(spark, path) if decoded else None
    file = share(spark, path)
    tok = load(file.value)
    head = spark.sparkContext.broadcast(dict(encode_words(tok, head_words(docs))))
    # as many places as the input has partitions, whatever the session's setting
    blocks = max(1, docs.rdd.getNumPartitions())
    buckets = min(BUCKETS, blocks)
    kind_of_id = unit(tok)
    gap = int(np.iinfo(kind_of_id).max)
    hole = np.array([gap], kind_of_id).tobytes()

    def holes(x):
        """Head ids with a hole for each other word, and those words; one row for the documents of a slice."""
        known, codes, rare = head.value, [], []
        for text in x["text"]:
            words = text.encode("utf-8", "replace").split()
            codes.append(b"".join([known.get(w, hole) for w in words]))
            rare += [w for w in words if w not in known]
        lengths = np.array([len(c) for c in codes], "<u4").tobytes()
        return {"block": x["block"][:1], "doc_ids": [x["doc_id"]], "words": [pack(b" ".join(rare))], "lengths": [pack(lengths)], "ids": [pack(b"".join(codes))]}

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, table = None, {}
        for batch in (b.slice(at, 1) for b in batches for at in range(b.num_rows)):
            b, docs_of, is_docs, words, lengths, ids = (c[0].as_py() for c in batch.columns)
            if b != block:
                block, table = b, {}
            words, lengths, ids = unpack(words).split(b" "), np.frombuffer(unpack(lengths), "<u4"), unpack(ids)
            ends = np.cumsum(lengths, dtype=np.int64)
            if not is_docs:
                table.update(zip(words, (ids[e - n : e] for n, e in zip(lengths.tolist(), ends.tolist()))))
                continue
            code = np.frombuffer(ids, kind_of_id)
            holes, n = code == gap, np.ones(len(code), np.int64)
            if holes.any():
                own = [table[w] for w in words]
                n[holes] = [len(o) // code.itemsize for o in own]
                code = np.repeat(code, n)
                code[np.repeat(holes, n)] = np.frombuffer(b"".join(own), kind_of_id)
            at = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], ends // code.itemsize])]
            code = code.astype("<u4")
            out = [code[i:j].tobytes() for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
            columns = {"doc_id": pa.array(docs_of, id_type), "ids": pa.array(out, pa.binary())}
            if pieces:
                columns["decoded"] = pa.array(_decoded(out, pieces.value), pa.string())
            yield pa.RecordBatch.from_pydict(columns)
        table = {}
        release()

    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    own = map_rows(_numbered(docs), holes, f"block int, doc_ids array<{kind.simpleString()}>, words binary, lengths binary, ids binary", SLICE)
    own = own.withColumn("is_docs", F.lit(True))
    table = _table(_rare(docs, head, buckets), file, buckets).withColumns({"is_docs": F.lit(False), "doc_ids": F.lit(None).cast(f"array<{kind.simpleString()}>")})
    rows = own.unionByName(table).select("block", "doc_ids", "is_docs", "words", "lengths", "ids")
    return rows.repartition(blocks, "block").sortWithinPartitions("block", "is_docs").mapInArrow(fill, f"doc_id {kind.simpleString()}, ids binary" + ", decoded string" * decoded)


def _pieces(spark, path: str):
    """The id-to-piece table, broadcast: its size is the vocabulary's."""
    with open(path, encoding="utf-8") as f:
        tok = load(f.read())
    if tok.decoder is not None:
        raise ValueError("the id-to-piece join decodes tokenizers without a decoder of their own")
    return spark.sparkContext.broadcast([tok.id_to_token(i) for i in range(tok.get_vocab_size())])


def _decoded(ids: list[bytes], pieces: list[str]) -> list[str]:
    return [" ".join([pieces[i] for i in np.frombuffer(b, "<u4").tolist()]) for b in ids]


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with the column ``decoded``: the pieces of the ids, special ones too, joined by blanks.

    That is the rule of tokenizers whose file names no decoder; others are refused.
    """
    pieces = _pieces(encoded.sparkSession, path)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != "decoded")
    return map_rows(encoded, lambda x: x | {"decoded": _decoded(x["ids"], pieces.value)}, f"{schema}, decoded string")
