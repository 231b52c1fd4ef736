"""The registered queries of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from evalspark.llm import bpe, collocations, fmindex, gridjoin, language, linededup, maxent, merkle, pii, resync, rules, simhash, weak
from evalspark.llm.frames import documents, held_out, materialize

#: The tokenizer of operators 5 and 6.
TOKENIZER = "word_bpe_49k.json"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path(TOKENIZER))


def query(fn, oracle: str | None = None):
    QUERIES[fn.__name__] = fn
    if oracle:
        ORACLES[fn.__name__] = oracle
    return fn


@query
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(documents(spark, sf_dir))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fmindex.occurrences(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    ids = F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256)
    out = found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), ids.alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


@query
def op5_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode(documents(spark, sf_dir), tokenizer_path(), decoded=True)
    hashes = [F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256") for c in ("ids", "decoded")]
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), *hashes)


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resync.token_counts(documents(spark, sf_dir), tokenizer_path())


@query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(rules.measured(documents(spark, sf_dir), "doc_id"), "measures")
    table = rules.cutoffs(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    base = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select("doc_id", "n_words", *base, rules.base_failed().alias("base_failed"), rules.kept(table).alias("kept"))


_LINES_SQL = f"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
every AS (SELECT doc_id, unnest(range(len(l))) AS ln, unnest(l) AS raw FROM split),
lines AS (
  SELECT doc_id, ln, trim(raw, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line FROM every
),
full_lines AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS i,
    len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words
  FROM lines WHERE line <> ''
),
sums AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM full_lines),
bounds AS (
  SELECT a.doc_id, a.i AS s, min(b.i) AS e FROM sums a JOIN sums b
    ON a.doc_id = b.doc_id AND b.i >= a.i AND b.i < a.i + {linededup.MIN_WORDS} AND b.upto - a.upto + a.words >= {linededup.MIN_WORDS} GROUP BY 1, 2
  UNION
  SELECT a.doc_id, max(b.i), a.i FROM sums a JOIN sums b
    ON a.doc_id = b.doc_id AND b.i <= a.i AND b.i > a.i - {linededup.MIN_WORDS} AND a.upto - b.upto + b.words >= {linededup.MIN_WORDS} GROUP BY 1, 3
),
runs AS (
  SELECT b.doc_id, b.s, b.e, string_agg(f.line, chr(10) ORDER BY f.i) AS run
  FROM bounds b JOIN full_lines f ON f.doc_id = b.doc_id AND f.i BETWEEN b.s AND b.e GROUP BY 1, 2, 3
),
later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, s) AS nth FROM runs) WHERE nth > 1),
gone AS (SELECT DISTINCT f.doc_id, f.ln, f.i FROM later r JOIN full_lines f ON f.doc_id = r.doc_id AND f.i BETWEEN r.s AND r.e),
spans AS (
  SELECT doc_id, min(ln) AS lo, max(ln) AS hi
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM gone) GROUP BY doc_id, island
),
rest AS (SELECT * FROM every e WHERE NOT EXISTS (SELECT 1 FROM spans s WHERE s.doc_id = e.doc_id AND e.ln BETWEEN s.lo AND s.hi)),
cleaned AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY ln) AS text, count(*) AS n FROM rest GROUP BY 1)
"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "doc_id", "n_removed", F.size("removed").cast("long").alias("n_runs"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256")
    )


query(op4_line_dedup, _LINES_SQL + """
SELECT d.doc_id, (SELECT count(*) FROM gone g WHERE g.doc_id = d.doc_id) AS n_removed,
  (SELECT count(*) FROM spans s WHERE s.doc_id = d.doc_id) AS n_runs, sha256(coalesce(c.text, '')) AS text_sha256
FROM documents d LEFT JOIN cleaned c ON c.doc_id = d.doc_id
""")


@query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_held_out(documents(spark, sf_dir)).select("doc_id", "held_out", "lang_pred", "score")


@query
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined("base").cast("binary"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"))


@query
def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(documents(spark, sf_dir), held_out(7))


def _tree_sql(name: str, group: str, n_levels: int = 8) -> str:
    """Levels of a tree over {name}0 (group, i, h), with the siblings before and after each node; a lone node stays as it is."""
    g, ctes = (f"{group}, " if group else ""), []
    for k in range(n_levels):
        total = f"count(*) OVER ({f'PARTITION BY {group}' if group else ''})"
        run = f"OVER (PARTITION BY {g}i // 8 ORDER BY i ROWS BETWEEN"
        ctes.append(f"""{name}s{k} AS (SELECT {g}i, h, {total} AS n,
  CASE WHEN {total} > 1 THEN coalesce(string_agg(h, '') {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') ELSE '' END AS b,
  CASE WHEN {total} > 1 THEN coalesce(string_agg(h, '') {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') ELSE '' END AS a FROM {name}{k})""")
        ctes.append(f"""{name}{k + 1} AS (SELECT {g}i // 8 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h
  FROM {name}s{k} GROUP BY {g}i // 8)""")
    return ",\n".join(ctes)


def _fold_sql(n_levels: int = 8) -> str:
    """Rows r0 (doc, g, i, gi, fold, proof) led through the trees of languages and of subroots."""
    ctes, k = [], 0
    for tree, key in (("t", "t.g = r.g AND t.i = r.i"), ("u", "t.i = r.gi")):
        for level in range(n_levels):
            up = "r.i // 8 AS i, r.gi" if tree == "t" else "r.i, r.gi // 8 AS gi"
            ctes.append(f"""r{k + 1} AS (SELECT r.doc, r.g, {up}, CASE WHEN t.n > 1 THEN sha256(t.b || r.fold || t.a) ELSE r.fold END AS fold, r.proof || t.b || t.a AS proof
  FROM r{k} r JOIN {tree}s{level} t ON {key})""")
            k += 1
    return ",\n".join(ctes)


_SIZED = "coalesce(strlen({0}) || ':' || {0}, '-')"
_LEAF_SQL = "sha256({})".format(" || ".join(_SIZED.format(c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "{text}")))
_MERKLE_SQL = f"""
WITH RECURSIVE bits AS (
  SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) r(i) UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
),
steps AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
hashed AS (
  SELECT row_number() OVER () AS doc, doc_id, lang, {_LEAF_SQL.format(text="text")} AS leaf,
    CASE WHEN doc_id IS NULL OR xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) % 3 = 0
    THEN {_LEAF_SQL.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS version
  FROM documents, steps
),
langs AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT lang FROM documents)),
leaves AS (
  SELECT h.*, l.g, row_number() OVER (PARTITION BY l.g ORDER BY doc_id NULLS FIRST, leaf, version NULLS FIRST) - 1 AS i
  FROM hashed h JOIN langs l ON h.lang IS NOT DISTINCT FROM l.lang
),
t0 AS (SELECT g, i, leaf AS h FROM leaves),
{_tree_sql("t", "g")},
u0 AS (SELECT g AS i, h FROM t8),
{_tree_sql("u", "")},
r0 AS (SELECT doc, g, i, g AS gi, coalesce(version, leaf) AS fold, '' AS proof FROM leaves),
{_fold_sql()}
SELECT l.doc_id, l.leaf, s.h AS subroot, u8.h AS root, sha256(r16.proof) AS proof_sha256, r16.fold AS folded_root, r16.fold = u8.h AS verified
FROM leaves l JOIN r16 ON r16.doc = l.doc JOIN t8 s ON s.g = l.g JOIN u8 ON TRUE
"""


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merkle.manifest(documents(spark, sf_dir))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


query(op13_merkle_manifest, _MERKLE_SQL)


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(documents(spark, sf_dir))


query(op11_phrase_collocations, f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
),
split AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split),
sums AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
f AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase, count(*) AS f
  FROM places, range(1, 4) r(m) WHERE i + m - 1 <= len(w) GROUP BY 1, 2, 3 HAVING count(*) >= {collocations.MIN_COUNT}
),
parts AS (
  SELECT c.lang, c.m, c.phrase, c.f AS a, k, string_split(c.phrase, ' ') AS w
  FROM f c, range(1, 3) r(k) WHERE k < c.m
),
cuts AS (
  SELECT p.lang, p.m, p.phrase, p.a, k, l.f AS l, r.f AS r, ((1000000::HUGEINT * p.a * p.a) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM parts p JOIN f l ON l.lang = p.lang AND l.phrase = array_to_string(p.w[1:k], ' ') JOIN f r ON r.lang = p.lang AND r.phrase = array_to_string(p.w[k + 1 :], ' ')
),
least AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM cuts) WHERE nth = 1),
around AS (
  SELECT lang, array_to_string(w[i : i + 1], ' ') AS phrase, max(a) AS ext
  FROM (SELECT DISTINCT lang, a, w FROM parts WHERE m = 3), range(1, 3) r(i) GROUP BY 1, 2
),
kept AS (SELECT c.* FROM least c LEFT JOIN around x ON x.lang = c.lang AND x.phrase = c.phrase WHERE x.ext IS NULL OR 100 * x.ext < {collocations.COVERED} * c.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT k.*, s.n, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept k JOIN sums s ON s.lang = k.lang
) WHERE rank <= {collocations.TOP}
""")


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridjoin.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


query(op12_embedding_near_dedup, f"""
WITH RECURSIVE fine AS (
  SELECT row_number() OVER () AS k, vec_id, label, embedding::DOUBLE[] AS v,
    label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
  FROM embeddings
),
links AS (
  SELECT a.k, b.k AS other, b.vec_id FROM fine a JOIN fine b ON a.label = b.label AND len(a.v) = len(b.v) AND a.k <> b.k AND a.ok AND b.ok
  WHERE list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)) >= {gridjoin.THRESHOLD}
),
reach AS (SELECT k, k AS other FROM fine UNION SELECT r.k, l.other FROM reach r JOIN links l ON l.k = r.other),
roots AS (SELECT r.k, min(f.vec_id) AS component_id FROM reach r JOIN fine f ON f.k = r.other GROUP BY 1),
sums AS (SELECT k, count(*) AS n FROM links GROUP BY 1)
SELECT f.vec_id, coalesce(s.n, 0) AS n_links, r.component_id, f.vec_id IS NOT DISTINCT FROM r.component_id AS kept
FROM fine f JOIN roots r ON r.k = f.k LEFT JOIN sums s ON s.k = f.k
""")
