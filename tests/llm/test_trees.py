"""The Merkle manifest against a plain tree."""

import zlib

import plain
import pytest
from test_llm import ROWS, bag, write

from evalspark.llm import merkle, queries
from evalspark.llm.frames import documents


def digest(r):
    parts = [None if r[c] is None else str(r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    return plain.sha("".join("-" if p is None else f"{len(p.encode())}:{p}" for p in parts))


def tree(nodes):
    """The hash that remains, and per node the (before, after) of each level."""
    steps, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(where):
            first = i // 8 * 8
            steps[k].append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + 8])))
        nodes = [plain.sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]
        where = [i // 8 for i in where]
    return nodes[0], steps


def manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified)."""
    rows = [r | {"leaf": digest(r), "other": digest(r | {"text": None if r["text"] is None else plain.lower(r["text"])})} for r in rows]
    for r in rows:
        changed = zlib.crc32(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"") % 3 == 0
        r["fold"] = r["other"] if changed else r["leaf"]
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r["lang"] == x), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["leaf"], r["fold"])) for x in langs]
    trees = [tree([r["leaf"] for r in g]) for g in groups]
    root, above = tree([t[0] for t in trees])
    out = []
    for g, (subroot, steps), upper in zip(groups, trees, above):
        for r, own in zip(g, steps):
            node = r["fold"]
            for before, after in own + upper:
                node = plain.sha(before + node + after)
            proof = plain.sha("".join(a + b for a, b in own + upper))
            out.append((r["doc_id"], r["leaf"], subroot, root, proof, node, node == root))
    return out


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("rows", [ROWS, ROWS[:1], [(i, f"Text {i}") for i in range(1100)], ROWS + [(7, "MANY Words " * 300_000)]], ids=["odd", "one", "many", "long"])
def test_manifest(spark, tmp_path, rows):
    path = write(tmp_path, rows, [], [])
    given = [r.asDict() for r in documents(spark, path).collect()]
    got = queries.QUERIES["op13_merkle_manifest"](spark, path).collect()
    assert bag(tuple(r[c] for c in COLUMNS) for r in got) == bag(manifest(given))


def test_versions_share_what_is_not_on_their_path(spark, tmp_path):
    path = write(tmp_path, [(i, f"Text {i}") for i in range(700)], [], [])
    rows = merkle.manifest(documents(spark, path).withColumn("lang", merkle.F.lit("en"))).collect()
    changed = [r for r in rows if r["version"]]
    assert changed and all(len(r["copied"]) == merkle.depth(700) and r["copied"][-1] == r["folded_root"] != r["root"] for r in changed)
    assert not any(r["copied"] for r in rows if not r["version"])


def test_shuffled_input_and_clashing_names(spark, tmp_path):
    path = write(tmp_path, ROWS, [], [])
    docs = documents(spark, path)
    for c in ("g", "i", "at", "h", "version", "_by_g"):
        docs = docs.withColumn(c, merkle.F.lit(1))
    rows = merkle.manifest(docs.repartition(7)).collect()
    again = merkle.manifest(docs.repartition(3, "text")).collect()
    assert bag(tuple(r[c] for c in COLUMNS[:-1]) for r in rows) == bag(tuple(r[c] for c in COLUMNS[:-1]) for r in again)
