"""Trust gate: panel plan, votes, tiers, repair and the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.cells import canon_rows
from ..functions.frames import ranked
from ..functions.text import col_of
from .match import rows_match

# --- fixed values -----------------------------------------------------------
PANEL = (("gen", 0.0), ("judge", 0.0), ("gen", 0.4), ("judge", 0.5), ("gen", 0.8))
REPAIR_PANEL = 3
TRUSTED = ("gold", "verified")
# ----------------------------------------------------------------------------


def panel_plan(items: DataFrame, k: int | Column = 5) -> DataFrame:
    """One row per item and panel member; the panel runs from k = 2 up to all five members.

    The five members are a literal array per row, so no join is needed.
    """
    size = k if isinstance(k, Column) else F.lit(int(k))
    members = F.array(
        *[
            F.struct(F.lit(i).alias("solver_idx"), F.lit(f).alias("family"), F.lit(t).alias("temperature"))
            for i, (f, t) in enumerate(PANEL)
        ]
    )
    chosen = F.when(size >= 2, F.slice(members, 1, F.least(size, F.lit(len(PANEL))).cast("int")))
    return items.withColumn("_m", F.explode(chosen)).select(*items.columns, "_m.*")


def gate_eligible(executes="sql_executes", nonempty="nonempty_result", deterministic="sql_deterministic") -> Column:
    """May the item be voted on?  An unknown determinism flag counts as deterministic."""
    return (
        F.coalesce(col_of(executes), F.lit(False))
        & F.coalesce(col_of(nonempty), F.lit(False))
        & F.coalesce(col_of(deterministic), F.lit(True))
    )


def derive_votes(items: DataFrame, solutions: DataFrame, on: list[str], expected="expected_rows", rows="solver_rows") -> DataFrame:
    """Each solver's rows against the item's expected rows; missing solver rows are no vote.

    ``items`` holds one row per key, ``solutions`` up to five, so the join
    cannot multiply; a hot key is split by the adaptive skew join.
    """
    # canonical once per item, not once per vote
    own = items.select(*on, canon_rows(expected).alias("_expected"))
    joined = solutions.join(own, on).withColumn("_voted", F.col(rows).isNotNull())
    return (
        rows_match(joined, "_expected", rows, "_match", canonical=True)
        .withColumn("verdict", F.when(F.col("_voted"), F.col("_match")))
        .select(*solutions.columns, "verdict")
    )


def tier_columns(n_match: Column, n_votes: Column, two_families: Column) -> Column:
    return (
        F.when(n_votes == 0, "not_evaluable")
        .when((n_match == n_votes) & two_families, "gold")
        .when((n_match * 2 > n_votes) & two_families, "verified")
        .otherwise("quarantine")
    )


def empirical_difficulty(n_match, n_votes) -> Column:
    m, v = col_of(n_match), col_of(n_votes)
    rate = F.try_divide(m, v)
    return (
        F.when(v == 0, "unknown")
        .when(m == 0, "suspect")
        .when(rate >= 0.8, "easy")
        .when(rate >= 0.4, "medium")
        .otherwise("hard")
    )


def panel_agreement(n_match, n_votes) -> Column:
    return F.round(F.try_divide(col_of(n_match), col_of(n_votes)), 2)


def verify_tier(votes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Votes ``(family, verdict)`` per question to tier, agreement and empirical difficulty.

    One aggregation with map-side partials.  Two matching families is the
    smallest matching family code differing from the largest, which needs no
    distinct count and so no second shuffle; 64-bit codes instead of names
    keep the aggregation in fixed-width hash buffers, without a sort.
    """
    by = list(by or ["question_id"])
    matched = F.when(F.col("verdict") & F.col("family").isNotNull(), F.xxhash64("family"))
    counted = votes.groupBy(*by).agg(
        F.count_if("verdict").alias("n_match"),
        F.count("verdict").alias("n_votes"),
        F.coalesce(F.min(matched) != F.max(matched), F.lit(False)).alias("_two"),
    )
    return counted.select(
        *by,
        "n_match",
        "n_votes",
        tier_columns(F.col("n_match"), F.col("n_votes"), F.col("_two")).alias("verify_tier"),
        panel_agreement("n_match", "n_votes").alias("verify_agreement"),
        empirical_difficulty("n_match", "n_votes").alias("difficulty_empirical"),
    )


def gate_items(items: DataFrame, tiers: DataFrame, on: list[str]) -> DataFrame:
    """Items with their gate columns; ineligible items are not evaluable whatever the votes say."""
    joined = items.join(tiers, on, "left")
    ok = gate_eligible() & F.col("verify_tier").isNotNull()
    return joined.select(
        *items.columns,
        F.when(ok, F.col("verify_tier")).otherwise("not_evaluable").alias("verify_tier"),
        F.when(ok, F.col("verify_agreement")).alias("verify_agreement"),
        F.when(ok, F.col("difficulty_empirical")).otherwise("unknown").alias("difficulty_empirical"),
        F.when(ok, F.col("n_match")).otherwise(F.lit(0)).cast("bigint").alias("n_match"),
        F.when(ok, F.col("n_votes")).otherwise(F.lit(0)).cast("bigint").alias("n_votes"),
    )


def repair_merge(gated: DataFrame, rewrites: DataFrame, revotes: DataFrame, on: list[str]) -> DataFrame:
    """Quarantined items whose rewritten question wins a re-vote take question and tier from it.

    ``rewrites`` is ``(key, new_question)``; ``revotes`` the second panel's
    votes, of which the first three members count.
    """
    second = verify_tier(revotes.where(F.col("solver_idx") < REPAIR_PANEL), on).select(
        *on,
        F.col("verify_tier").alias("_t2"),
        F.col("verify_agreement").alias("_a2"),
        F.col("difficulty_empirical").alias("_d2"),
    )
    joined = gated.join(rewrites.select(*on, "new_question"), on, "left").join(second, on, "left")
    won = F.coalesce(
        (F.col("verify_tier") == "quarantine")
        & (F.col("new_question") != F.col("question"))
        & F.col("_t2").isin(*TRUSTED),
        F.lit(False),
    )
    merged = {
        "question": F.when(won, F.col("new_question")).otherwise(F.col("question")),
        "verify_tier": F.when(won, F.col("_t2")).otherwise(F.col("verify_tier")),
        "verify_agreement": F.when(won, F.col("_a2")).otherwise(F.col("verify_agreement")),
        "difficulty_empirical": F.when(won, F.col("_d2")).otherwise(F.col("difficulty_empirical")),
    }
    return joined.select(
        *[merged[c].alias(c) if c in merged else F.col(c) for c in gated.columns],
        F.when(won, F.col("question")).otherwise("").alias("question_orig"),
        won.alias("verify_repaired"),
    )


def gate_metrics(gated: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts per tier, verified fraction of the gated items and mean panel agreement."""
    tier = F.col("verify_tier")
    repaired = F.col("verify_repaired") if "verify_repaired" in gated.columns else F.lit(False)
    m = gated.groupBy(*(by or [])).agg(
        F.count_if(tier != "not_evaluable").alias("n_gated"),
        F.count_if(tier == "gold").alias("gold_count"),
        F.count_if(tier == "verified").alias("verified_count"),
        F.count_if(tier == "quarantine").alias("quarantine_count"),
        F.count_if(repaired).alias("repaired_count"),
        F.avg(F.when(tier != "not_evaluable", F.col("verify_agreement"))).alias("mean_panel_agreement"),
    )
    share = F.try_divide(F.col("gold_count") + F.col("verified_count"), F.col("n_gated"))
    return m.withColumn("verified_fraction", F.coalesce(share, F.lit(0.0)))


def review_queue(gated: DataFrame, tie_break: str = "question_id") -> DataFrame:
    """Quarantined items with their ``place`` (from 1), those without a single match first, then the least agreed on."""
    order = [(F.col("difficulty_empirical") == "suspect").desc(), F.col("verify_agreement").asc_nulls_first(), F.col(tie_break).asc()]
    queue = ranked(gated.where(F.col("verify_tier") == "quarantine"), [], order, "review-queue")
    return queue.withColumn("place", F.col("rank") + 1).drop("at", "rank")
