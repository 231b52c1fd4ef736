"""Question history, curated questions and label files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import strip
from ..operators.profile import first_rows

# --- fixed values -----------------------------------------------------------
HISTORY_STATUSES = ("COMPLETED", "FAILED", "QUERY_RESULT_EXPIRED")
MAX_CONVERSATIONS = 50
LABEL_SCHEMA = "item_id string, judge string, judge_label string, human_label string"
# ----------------------------------------------------------------------------

CONVERSATION_SCHEMA = (
    "space_id string, conversation_id string, id string, messages array<struct<content:string,status:string,"
    "created_timestamp:bigint,attachments:array<struct<query:struct<query:string,description:string>>>>>"
)


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """Conversation documents, one JSON object a line, schema given so that nothing is inferred."""
    return spark.read.schema(CONVERSATION_SCHEMA).json(path)


def history_messages(conversations: DataFrame, max_conversations: int | None = None) -> DataFrame:
    """One row per message in a final state, with the first attached query that is not empty.

    With ``max_conversations`` only that many conversations of each space
    count, in order of id.  They are chosen on the ids alone, and tasks cut to
    the cap before the shuffle, so the documents themselves are never sorted.
    """
    ident = F.coalesce(F.nullif("conversation_id", F.lit("")), F.nullif("id", F.lit("")))
    conv = conversations.withColumn("_cid", ident).where(F.col("_cid").isNotNull())
    if max_conversations is not None:
        chosen = first_rows(conv.select("space_id", "_cid").distinct(), ["space_id"], ["_cid"], max_conversations)
        conv = conv.join(chosen.drop("_rn"), ["space_id", "_cid"], "left_semi")
    msg = conv.select("space_id", F.col("_cid").alias("conversation_id"), F.posexplode("messages").alias("msg_idx", "m"))
    with_query = F.filter("m.attachments", lambda a: F.coalesce(a["query"]["query"], F.lit("")) != "")
    first = F.get(with_query, F.lit(0))
    return msg.where(F.col("m.status").isin(*HISTORY_STATUSES)).select(
        "space_id", "conversation_id", "msg_idx",
        strip(F.coalesce("m.content", F.lit(""))).alias("question"),
        F.coalesce(first["query"]["query"], F.lit("")).alias("answer_sql"),
        F.coalesce(first["query"]["description"], F.lit("")).alias("answer_description"),
        F.col("m.status").alias("status"),
        F.col("m.created_timestamp").alias("created_ts"),
    )


def curated_text(*columns: str) -> Column:
    """The first of the text columns that is not empty, else empty text."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns], F.lit(""))


def reference_corpus(history: DataFrame, curated: DataFrame, by: list[str] | None = None) -> DataFrame:
    """History questions with their repeats, then curated texts not seen before, with a rank of origin.

    ``history`` is ``(by…, pos, question)``, ``curated`` is ``(by…, pos, text)``.
    """
    by = list(by or [])
    h = history.where(F.coalesce("question", F.lit("")) != "").select(*by, F.lit(0).alias("origin"), "pos", "question")
    c = (
        curated.select(*by, "pos", strip("text").alias("question")).where(F.coalesce("question", F.lit("")) != "")
        .groupBy(*by, "question").agg(F.min("pos").alias("pos"))
        .join(h.select(*by, "question").distinct(), [*by, "question"], "left_anti")
    )
    return h.unionByName(c.select(*by, F.lit(1).alias("origin"), "pos", "question"))


def corpus_counts(history: DataFrame, curated: DataFrame, corpus: DataFrame, by: list[str]) -> DataFrame:
    """History, non-blank curated and corpus sizes per group, from one stacked count."""

    def part(df: DataFrame, cond: Column, which: str) -> DataFrame:
        return df.where(cond).groupBy(*by).agg(F.count("*").alias("n")).select(
            *by, *[(F.col("n") if w == which else F.lit(0).cast("bigint")).alias(w) for w in ("n_history", "n_curated", "n_ref")]
        )

    stacked = (
        part(history, F.coalesce("question", F.lit("")) != "", "n_history")
        .unionByName(part(curated, strip(F.coalesce("text", F.lit(""))) != "", "n_curated"))
        .unionByName(part(corpus, F.lit(True), "n_ref"))
    )
    return stacked.groupBy(*by).agg(*[F.sum(w).alias(w) for w in ("n_history", "n_curated", "n_ref")])


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Judge and human labels from CSV with a header; a file without rows is an error."""
    df = spark.read.schema(LABEL_SCHEMA).csv(path, header=True)
    if df.isEmpty():
        raise ValueError(f"no label rows in {path}")
    return df
