"""Judges against human labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import col_of, strip

# --- fixed values -----------------------------------------------------------
TRUE_LABELS = ("1", "true", "pass", "yes", "y", "t")
FALSE_LABELS = ("0", "false", "fail", "no", "n", "f")
KAPPA_FLOOR = 0.6
MIN_LABELS = 10
# ----------------------------------------------------------------------------


def to_binary(label) -> Column:
    """1 or 0, NULL for a label that is neither."""
    v = F.lower(strip(F.coalesce(col_of(label), F.lit(""))))
    return F.when(v.isin(*TRUE_LABELS), 1).when(v.isin(*FALSE_LABELS), 0)


def code_labels(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Label rows with ``judge_bit`` and ``human_bit``, and the rows that cannot be coded."""
    coded = labels.withColumn("judge_bit", to_binary("judge_label")).withColumn("human_bit", to_binary("human_label"))
    bad = F.col("judge_bit").isNull() | F.col("human_bit").isNull()
    return coded.where(~bad), coded.where(bad)


def _strict(label: str) -> Column:
    bit = to_binary(label)
    complaint = F.concat(F.lit("unrecognised label: "), F.coalesce(F.col(label), F.lit("NULL")))
    return F.when(bit.isNull(), F.raise_error(complaint).cast("int")).otherwise(bit)


def calibrate(labels: DataFrame, floor: float = KAPPA_FLOOR, by: tuple[str, ...] = ("judge",), strict: bool = True) -> DataFrame:
    """Kappa, raw agreement, positive rates and verdict per judge, in one aggregation.

    An unknown label fails the job unless ``strict`` is off, in which case it is skipped
    (see :func:`code_labels` for the rejects).
    """
    coder = _strict if strict else to_binary
    coded = labels.select(*by, coder("judge_label").alias("j"), coder("human_label").alias("h"))
    if not strict:
        coded = coded.where(F.col("j").isNotNull() & F.col("h").isNotNull())
    s = coded.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg((F.col("j") == F.col("h")).cast("int")).alias("raw_agreement"),
        F.avg("j").alias("judge_pos_rate"),
        F.avg("h").alias("human_pos_rate"),
    )
    pj, ph = F.col("judge_pos_rate"), F.col("human_pos_rate")
    chance = pj * ph + (1 - pj) * (1 - ph)
    s = s.withColumn("kappa", F.when(chance >= 1, 1.0).otherwise(F.try_divide(F.col("raw_agreement") - chance, 1 - chance)))
    enough, one_class = F.col("n") >= MIN_LABELS, ph.isin(0.0, 1.0)
    s = s.withColumn("gated", enough & ~one_class)
    # fixed values: the texts of a verdict
    return s.withColumn(
        "verdict",
        F.when(enough & one_class, "not calibratable (single-class human labels)")
        .when(~F.col("gated"), "—")
        .when(F.col("kappa") >= floor, "OK")
        .otherwise(f"BELOW κ {floor}"),
    )


def calibration_passes(stats: DataFrame, floor: float = KAPPA_FLOOR) -> DataFrame:
    """One row: judges below the floor and whether all gated judges clear it."""
    below = F.col("gated") & (F.col("kappa") < floor)
    return stats.agg(
        F.count("*").alias("n_judges"), F.count_if(below).alias("n_below"), F.coalesce(~F.bool_or(below), F.lit(True)).alias("passed")
    )
