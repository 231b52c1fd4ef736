"""The operators chained in their fixed order: items, gate, grading."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .functions.frames import attach
from .operators import diversity, gate, items as it, regress
from .operators.validate import execute_items
from .session import materialize


def cleaning_stages(
    catalog: DataFrame, by: list[str], pos: str = "pos", vec: str | None = None, threshold: float = diversity.DEDUP_COSINE
) -> list[tuple[str, Callable[[DataFrame], DataFrame]]]:
    """The named steps from raw to clean items.  Both deduplications keep the first item by ``pos``, so their order matters."""
    typed_by = by if set(by) <= set(catalog.columns) else None
    stages = [
        ("malformed", it.normalise_items),
        ("relative_time", it.drop_relative_time),
        ("typed_aggregate", lambda df: it.drop_typed_violations(df, catalog, typed_by)),
        ("same_skeleton", lambda df: it.dedup_skeleton(df, by, pos)),
    ]
    if vec is not None:
        stages.append(("near_question", lambda df: diversity.greedy_dedup(df, by, pos, vec, threshold)))
    return stages


def labelled(items: DataFrame, by: list[str], pos: str = "pos") -> DataFrame:
    """Clean items with structural difficulty and id."""
    return it.structural_labels(items).withColumn("question_id", it.item_id(by, pos))


def build_items(
    raw: DataFrame, catalog: DataFrame, by: list[str], pos: str = "pos", vec: str | None = None, threshold: float = diversity.DEDUP_COSINE
) -> DataFrame:
    """Raw reply items to clean ones: normalise, reject, check, deduplicate, label, number."""
    out = raw
    for _, stage in cleaning_stages(catalog, by, pos, vec, threshold):
        out = stage(out)
    return labelled(out, by, pos)


def build_accounted(
    raw: DataFrame, catalog: DataFrame, by: list[str], pos: str = "pos", vec: str | None = None, threshold: float = diversity.DEDUP_COSINE
) -> tuple[DataFrame, DataFrame]:
    """The same over written tables, and the account: (by…, step, stage, n_in, n_out) of every stage and group that reached it.

    Each stage reads what its predecessor wrote, so an account counts the very
    rows that went on, and a lost executor repeats one stage at most.
    """
    out, account = materialize(raw, "raw-items"), []
    for k, (name, stage) in enumerate(cleaning_stages(catalog, by, pos, vec, threshold)):
        after = materialize(stage(out), f"items-{name}")
        n_in, n_out = (df.groupBy(*by).agg(F.count("*").alias(c)) for df, c in ((out, "n_in"), (after, "n_out")))
        rows = n_in.join(n_out, by, "left") if by else attach(n_in, n_out, [])
        account.append(rows.select(*by, F.lit(k).alias("step"), F.lit(name).alias("stage"), "n_in", F.coalesce("n_out", F.lit(0)).alias("n_out")))
        out = after
    return labelled(out, by, pos), reduce(DataFrame.unionByName, account)


def validate_items(items: DataFrame) -> DataFrame:
    """Items with the captures of their statements."""
    return items.join(execute_items(items, "question_id"), "question_id", "left")


def verify_items(items: DataFrame, votes: DataFrame, rewrites: DataFrame | None = None, revotes: DataFrame | None = None) -> DataFrame:
    """Items with tier, agreement and difficulty, repaired where a rewritten question won its re-vote."""
    key = ["question_id"]
    gated = gate.gate_items(items, gate.verify_tier(votes, key), key)
    if rewrites is None or revotes is None:
        return gated.withColumn("question_orig", F.lit("")).withColumn("verify_repaired", F.lit(False))
    return gate.repair_merge(gated, rewrites, revotes, key)


def grade_items(items: DataFrame, answers: DataFrame) -> DataFrame:
    """Trusted items graded against their canonical answers.

    ``answers`` is ``(question_id, run_idx, answer_rows, answer_error)``, rows as arrays.
    """
    chosen = regress.attach_answers(regress.eligible(items), answers, ["question_id"])
    if "engine_rows_json" not in chosen.columns:
        chosen = chosen.withColumn("engine_rows_json", F.lit(None).cast("string"))
    return regress.grade(regress.expected_source(chosen))
