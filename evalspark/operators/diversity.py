"""Diversity of a generated set and its leakage from the reference questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.frames import attach
from ..functions.stats import exact_quantile
from ..session import materialize
from .near import greedy_keep, nearest, unit_vector

# --- fixed values -----------------------------------------------------------
DEDUP_COSINE = 0.92
LEAK_COSINE, LEAK_SHARE = 0.97, 0.10
MIN_REFERENCE = 10
# ----------------------------------------------------------------------------


def unit(df: DataFrame, id_col: str = "id", vec: str = "embedding", by: list[str] | None = None) -> DataFrame:
    """``(by…, id, v)`` with v normalised; rows without a whole vector have no place in any search."""
    whole = F.col(vec).isNotNull() & ~F.exists(vec, lambda x: x.isNull())
    return df.where(whole).select(*(by or []), F.col(id_col).cast("bigint").alias("id"), unit_vector(vec).alias("v"))


def nearest_reference(generated: DataFrame, reference: DataFrame, by: list[str] | None = None) -> DataFrame:
    return nearest(generated, reference, by)


def nn_summary(nn: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean and 10th percentile (linear interpolation) of the nearest cosine.

    The search behind ``nn`` is costly and the quantile reads its input three
    times, so the cosines are written once.
    """
    by = list(by or [])
    nn = materialize(nn.select(*by, "nn_sim"), "cosines")
    mean = nn.groupBy(*by).agg(F.count("*").alias("n_generated"), F.avg("nn_sim").alias("mean_nn_cosine"))
    p10 = exact_quantile(nn, "nn_sim", 0.10, by, "nn_cosine_p10")
    return mean.join(p10, by, "left") if by else attach(mean, p10, by)


def self_similarity(vectors: DataFrame, by: list[str] | None = None, name: str = "self_similarity") -> DataFrame:
    """Mean over vectors of the greatest cosine to another one; 0 for a single vector.

    A vector's own entry counts as ‖v‖² − 1, that is about 0, so a set of
    mutually opposed vectors scores 0 rather than less.
    """
    by = list(by or [])
    own = vectors.select(
        *by, "id",
        (F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) - 1.0).alias("own"),
    )
    best = own.join(nearest(vectors, vectors, by, skip_self=True).select(*by, "id", "nn_sim"), [*by, "id"], "left")
    s = best.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.greatest("own", "nn_sim")).alias("_m")
    )
    return s.select(*by, "n", F.when(F.col("n") > 1, F.col("_m")).otherwise(0.0).alias(name))


def leakage(nn: DataFrame, by: list[str] | None = None, cosine: float = LEAK_COSINE, share: float = LEAK_SHARE) -> DataFrame:
    """Share of items almost equal to a reference question, and whether that is too many."""
    s = nn.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.avg((F.col("nn_sim") >= cosine).cast("int")).alias("leakage_fraction")
    )
    return s.withColumn("leakage_risk", F.col("leakage_fraction") >= share)


def corpus_gate(reference: DataFrame, by: list[str], vec: str = "v", minimum: int = MIN_REFERENCE) -> DataFrame:
    """Is the reference corpus of each group large enough, and if not, why is it skipped?"""
    s = reference.groupBy(*by).agg(F.count("*").alias("n_ref"), F.count(vec).alias("n_embedded"))
    reason = (
        F.when(F.col("n_embedded") == 0, "no embeddings")
        .when(F.col("n_ref") < minimum, F.concat(F.lit("reference corpus too small: "), F.col("n_ref").cast("string")))
    )
    return s.withColumn("computed", reason.isNull()).withColumn("skip_reason", F.coalesce(reason, F.lit("")))


def join_back(items: DataFrame, nn: DataFrame, on: list[str]) -> DataFrame:
    """Items with ``diversity_nn_sim``, by id; question text would not be unique."""
    return items.join(nn.select(*on, F.col("nn_sim").alias("diversity_nn_sim")), on, "left")


def greedy_dedup(items: DataFrame, by: list[str] | None = None, pos: str = "pos", vec: str = "embedding", threshold: float = DEDUP_COSINE) -> DataFrame:
    """Items kept by the greedy pass in ``pos`` order; items without a vector are kept."""
    by = list(by or [])
    have = items.where(F.col(vec).isNotNull())
    keep = greedy_keep(unit(have, pos, vec, by), by, threshold).withColumnRenamed("id", "_pos")
    key = F.col(pos).cast("bigint")
    kept = have.withColumn("_pos", key).join(keep, [*by, "_pos"], "left_semi").drop("_pos")
    return kept.select(*items.columns).unionByName(items.where(F.col(vec).isNull()))
