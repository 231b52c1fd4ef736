"""Comparison of result sets: per item (bounded rows) and of whole tables."""

from __future__ import annotations

from decimal import Decimal
from functools import reduce
from math import isfinite
from operator import or_

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType

from ..functions.cells import ABS_TOL, MAX_WIDTH, REL_TOL, ROW_CAP, canon_cell, canon_rows, parse_rows
from ..functions.text import col_of

_ABS, _REL = Decimal(ABS_TOL), Decimal(REL_TOL)
_ABS_F, _REL_F = float(ABS_TOL), float(REL_TOL)


def _number(cell: str) -> float | None:
    try:
        x = float(cell)
    except ValueError:
        return None
    # text such as "nan" is no number; only a long row of digits may overflow
    return x if isfinite(x) or cell.lstrip("-")[:1].isdigit() else None


def _within(a: str, b: str, x: float, y: float) -> bool:
    """Tolerance test; binary arithmetic settles the clear cases, decimal the close ones."""
    gap, size = abs(x - y), max(abs(x), abs(y))
    if isfinite(size):
        if gap > 1.01 * _REL_F * size + 2 * _ABS_F:
            return False
        if gap < 0.99 * _REL_F * size:
            return True
    exact_a, exact_b = Decimal(a), Decimal(b)
    gap = abs(exact_a - exact_b)
    return gap <= _ABS or gap <= _REL * max(abs(exact_a), abs(exact_b))


def _close_masks(left: list[str], right: list[str], numbers: dict[str, float | None]) -> list[int]:
    """Per cell of one column, a bit set of the cells of the other it may stand for."""
    seen: dict[str, int] = {}
    for a in left:
        if a in seen:
            continue
        mask, x = 0, numbers[a]
        for j, b in enumerate(right):
            if a == b:
                mask |= 1 << j
            elif x is not None and ("." in a or "." in b):
                y = numbers[b]
                if y is not None and _within(a, b, x, y):
                    mask |= 1 << j
        seen[a] = mask
    return [seen[a] for a in left]


def _greedy_cover(masks: list[int]) -> bool:
    """Each expected row, in captured order, takes the first free actual row it may match."""
    taken = 0
    for mask in masks:
        free = mask & ~taken
        if not free:
            return False
        taken |= free & -free
    return True


def _columns_agree(expected: list[list[str]], actual: list[list[str]]) -> bool:
    """Is there one assignment of actual to expected columns under which the rows match?

    Depth-first over expected columns.  The row pairs left by a partial
    assignment are the AND of its columns' pairs, so a branch ends as soon as
    some row has no partner left; 7! is never enumerated blindly.
    An exact match is also a tolerant one for columns of equal cells, but the
    greedy cover is order dependent, so exact equality is tried on its own.
    """
    width = len(expected[0])
    e_cols = [[r[c] for r in expected] for c in range(width)]
    g_cols = [[r[c] for r in actual] for c in range(width)]

    if sorted(v for c in e_cols for v in c) == sorted(v for c in g_cols for v in c):
        bags = [sorted(c) for c in g_cols]
        want = sorted(map(tuple, expected))

        def exact(c: int, chosen: list[int]) -> bool:
            if c == width:
                return sorted(tuple(r[i] for i in chosen) for r in actual) == want
            bag = sorted(e_cols[c])
            return any(
                bags[i] == bag and exact(c + 1, [*chosen, i]) for i in range(width) if i not in chosen
            )

        if exact(0, []):
            return True

    numbers = {v: _number(v) for col in (*e_cols, *g_cols) for v in col}
    every = (1 << len(actual)) - 1
    masks: dict[tuple[int, int], list[int]] = {}

    def tolerant(c: int, used: frozenset, rows: list[int]) -> bool:
        # a branch needs a partner left for every row, expected and actual
        if not all(rows) or reduce(or_, rows) != every:
            return False
        if c == width:
            return _greedy_cover(rows)
        for i in range(width):
            if i in used:
                continue
            if (c, i) not in masks:
                masks[c, i] = _close_masks(e_cols[c], g_cols[i], numbers)
            if tolerant(c + 1, used | {i}, [r & m for r, m in zip(rows, masks[c, i])]):
                return True
        return False

    return tolerant(0, frozenset(), [every] * len(expected))


@F.arrow_udf(BooleanType())
def _close(a: pa.Array, b: pa.Array) -> pa.Array:
    pairs = zip(a.to_pylist(), b.to_pylist())
    return pa.array([None if x is None else bool(_close_masks([x], [y], {x: _number(x), y: _number(y)})[0]) for x, y in pairs], type=pa.bool_())


def cells_close(a, b) -> Column:
    """May one canonical cell stand for the other?  The very rule by which rows are matched.

    Equal texts, or two numbers, one with a fraction, within tolerance; what
    the texts alone decide does not leave the JVM.
    """
    a, b = col_of(a), col_of(b)
    ask = (a != b) & (a.contains(".") | b.contains("."))
    return F.when(a.isNull() | b.isNull(), None).when(ask, _close(F.when(ask, a), F.when(ask, b))).otherwise(a == b)


@F.arrow_udf(BooleanType())
def _match_permutation(expected: pa.Array, actual: pa.Array) -> pa.Array:
    # most pairs are decided and come as nulls
    asked = pc.and_(expected.is_valid(), actual.is_valid())
    found = [_columns_agree(e, g) for e, g in zip(expected.filter(asked).to_pylist(), actual.filter(asked).to_pylist())]
    return pc.replace_with_mask(pa.nulls(len(asked), pa.bool_()), asked, pa.array(found, type=pa.bool_()))


def bag_equal(expected, actual) -> Column:
    """Same rows with the same multiplicities, columns in order (canonical rows in)."""
    return F.sort_array(col_of(expected)) == F.sort_array(col_of(actual))


def _ragged(rows: Column, width: Column) -> Column:
    return F.exists(rows, lambda r: F.size(r) != width)


_DIGIT = r"(?U)\d"
_DECIMAL = r"^-?[0-9]+(?:\.[0-9]+)?$"


def _settled(df: DataFrame) -> DataFrame:
    """Decides the pairs (_e, _g: canonical, same size, same width) with ``_open`` true, as far as exact tests go.

    Adds ``_exact`` (TRUE or FALSE where decided, NULL where Python must look)
    and nothing else.  Pairs whose cells, each in its place, are equal or
    clearly within tolerance match: the first free row that an expected row
    may take is then at the latest its own.  Of the others, columns are put in the order of their bags of cells;
    where all bags differ that order is the only permutation under which the
    rows can be equal.  Where the bags differ between the sides no permutation
    makes them equal, and without a fraction no tolerance helps.  With one,
    the cells without a digit must still agree as bags, and the numbers, each
    side sorted, must agree one by one: closeness bounds grow with the value,
    so if any pairing is close the sorted one is.
    """

    def bags(rows: str) -> Column:
        width = F.size(F.get(rows, F.lit(0)))
        column = lambda c: F.sort_array(F.transform(rows, lambda r: F.get(r, c)))
        return F.sort_array(F.transform(F.sequence(F.lit(0), width - 1), lambda c: F.struct(column(c).alias("bag"), c.alias("at"))))

    def ordered(rows: str, by: str) -> Column:
        return F.sort_array(F.transform(rows, lambda r: F.transform(by, lambda x: F.get(r, x["at"]))))

    def numbers(cells: str) -> Column:
        return F.sort_array(F.transform(F.filter(cells, lambda c: c.rlike(_DIGIT)), lambda c: c.try_cast("double")))

    def words(cells: str) -> Column:
        return F.sort_array(F.filter(cells, lambda c: ~c.rlike(_DIGIT)))

    def stands_for(p: Column) -> Column:
        a, b = p["a"], p["b"]
        x, y = a.try_cast("double"), b.try_cast("double")
        clear = F.abs(x - y) < 0.99 * _REL_F * F.greatest(F.abs(x), F.abs(y))
        return (a == b) | ((a.contains(".") | b.contains(".")) & a.rlike(_DECIMAL) & b.rlike(_DECIMAL) & clear)

    wide = F.col("_open") & (F.size(F.get("_e", F.lit(0))) > 0)
    df = df.withColumns({f"_f{s}": F.when(wide, F.flatten(f"_{s}")) for s in "eg"})
    placed = F.forall(F.arrays_zip(F.col("_fe").alias("a"), F.col("_fg").alias("b")), stands_for)
    df = df.withColumn("_placed", F.coalesce(placed, F.lit(False)))
    usable = wide & ~F.col("_placed")
    df = df.withColumns({"_be": F.when(usable, bags("_e")), "_bg": F.when(usable, bags("_g"))})
    same = F.transform("_be", lambda x: x["bag"]) == F.transform("_bg", lambda x: x["bag"])
    alone = F.size(F.array_distinct(F.transform("_be", lambda x: x["bag"]))) == F.size("_be")
    # 2: equal rows; 1: no permutation makes them equal; 0: equal columns, to be told apart by search
    df = df.withColumn("_same", same).withColumn(
        "_rank",
        F.when(~usable, None).when(~F.col("_same"), 1).when(~alone, 0).when(ordered("_e", "_be") == ordered("_g", "_bg"), 2).when(F.col("_same"), 1),
    )
    dotted = F.exists("_fe", lambda c: c.contains(".")) | F.exists("_fg", lambda c: c.contains("."))
    df = df.withColumn("_dotted", F.when(F.col("_rank") == 1, dotted))
    look = F.col("_dotted")
    df = df.withColumns({f"_{k}{s}": F.when(look, f(f"_f{s}")) for s in "eg" for k, f in (("w", words), ("n", numbers))})
    # a cell with digits that is no plain number can have any form: Python decides
    plain = F.forall("_fe", lambda c: ~c.rlike(_DIGIT) | c.rlike(_DECIMAL)) & F.forall("_fg", lambda c: ~c.rlike(_DIGIT) | c.rlike(_DECIMAL))
    near = F.forall(
        F.arrays_zip(F.col("_ne").alias("a"), F.col("_ng").alias("b")),
        lambda p: F.coalesce(F.abs(p["a"] - p["b"]) <= 1.01 * _REL_F * F.greatest(F.abs(p["a"]), F.abs(p["b"])) + 2 * _ABS_F, F.lit(False)),
    )
    exact = (
        F.when(F.col("_placed") | (F.col("_rank") == 2), True)
        .when(F.col("_rank") == 0, None)
        .when(~F.col("_dotted"), False)
        .when(F.col("_we") != F.col("_wg"), False)
        .when(plain & ~near, False)
    )
    extra = ["_placed", "_be", "_bg", "_same", "_rank", "_fe", "_fg", "_dotted", "_we", "_wg", "_ne", "_ng"]
    return df.withColumn("_exact", exact).drop(*extra)


def _searched(df: DataFrame) -> DataFrame:
    """``_found``: the verdict of the open pairs; only those that exact tests leave open hand their cells to Python."""
    df = _settled(df).withColumn("_ask", F.col("_open") & F.col("_exact").isNull())
    df = df.withColumn("_asked", _match_permutation(F.when(F.col("_ask"), F.col("_e")), F.when(F.col("_ask"), F.col("_g"))))
    return df.withColumn("_found", F.coalesce("_exact", "_asked")).drop("_exact", "_ask", "_asked")


def match_permutation(pairs: DataFrame, expected: str, actual: str, verdict: str = "verdict") -> DataFrame:
    """Do the row sets match under one column permutation?  False where length or width differ."""
    staged = pairs.withColumn("_e", canon_rows(expected)).withColumn("_g", canon_rows(actual))
    width = F.size(F.get("_e", F.lit(0)))
    square = (F.size("_e") == F.size("_g")) & (F.size("_e") > 0) & ~_ragged(F.col("_e"), width) & ~_ragged(F.col("_g"), width)
    staged = staged.withColumn("_open", F.coalesce(square, F.lit(False)))
    return _searched(staged).withColumn(verdict, F.coalesce("_found", F.lit(False))).drop("_e", "_g", "_open", "_found")


def rows_match(
    pairs: DataFrame,
    expected: str,
    actual: str,
    verdict: str = "verdict",
    cap: int = ROW_CAP,
    max_width: int = MAX_WIDTH,
    canonical: bool = False,
) -> DataFrame:
    """Adds the three-valued verdict of comparing two captured row sets.

    NULL means not evaluable.  The tests run in a fixed order and decide almost
    every pair inside the JVM; only same-size pairs that differ in rounding, or
    whose columns cannot be told apart, hand their cells to Python.  With
    ``canonical`` the expected rows are in canonical form already.
    """
    e, g = F.col(expected), F.col(actual)
    sized = (
        pairs.withColumn(
            "_state",
            F.when(e.isNull(), "null")
            .when(g.isNull(), "false")
            .when((F.size(e) > cap) | (F.size(g) > cap), "null")
            .when(F.size(e) != F.size(g), "false")
            .when(F.size(e) == 0, "null"),
        )
        # cells are put in canonical form only where the sizes left the verdict open
        .withColumn("_e", F.when(F.col("_state").isNull(), e if canonical else canon_rows(e)))
        .withColumn("_g", F.when(F.col("_state").isNull(), canon_rows(g)))
    )
    width = F.size(F.get("_e", F.lit(0)))
    staged = sized.withColumn(
        "_state",
        F.when(F.col("_state").isNotNull(), F.col("_state"))
        .when(bag_equal("_e", "_g"), "true")
        .when(_ragged(F.col("_e"), width) | _ragged(F.col("_g"), width), "false")
        .when(width > max_width, "null")
        .otherwise("open"),
    )
    searched = _searched(staged.withColumn("_open", F.col("_state") == "open"))
    return searched.withColumn(
        verdict,
        F.when(F.col("_open"), F.col("_found")).when(F.col("_state") == "true", True).when(F.col("_state") == "false", False),
    ).drop("_state", "_e", "_g", "_found", "_open")


def rows_match_json(pairs: DataFrame, expected: str, actual: str, verdict: str = "verdict", **kw) -> DataFrame:
    """:func:`rows_match` on row sets stored as JSON text."""
    parsed = pairs.withColumn("_pe", parse_rows(expected)).withColumn("_pg", parse_rows(actual))
    return rows_match(parsed, "_pe", "_pg", verdict, **kw).drop("_pe", "_pg")


def multiset_diff(left: DataFrame, right: DataFrame, columns: list[str] | None = None, canonical: bool = True) -> DataFrame:
    """Distinct rows, cells as canonical (or plain) text, of two whole tables with their multiplicity on each side.

    One shuffle: the sides are stacked and counted together, and map-side
    partial counts keep a row repeated billions of times cheap.
    """
    names = list(columns or left.columns)
    form = canon_cell if canonical else lambda c: c.cast("string")

    def side(df: DataFrame, l: int, r: int) -> DataFrame:
        return df.select(
            *[form(F.col(f"`{c}`")).alias(n) for n, c in zip(names, df.columns)],
            F.lit(l).cast("bigint").alias("_l"),
            F.lit(r).cast("bigint").alias("_r"),
        )

    counted = (
        side(left, 1, 0).unionAll(side(right, 0, 1))
        .groupBy(*names)
        .agg(F.sum("_l").alias("n_left"), F.sum("_r").alias("n_right"))
    )
    return counted.select(
        *names,
        "n_left",
        "n_right",
        F.greatest(F.col("n_left") - F.col("n_right"), F.lit(0)).alias("only_left"),
        F.greatest(F.col("n_right") - F.col("n_left"), F.lit(0)).alias("only_right"),
        F.least("n_left", "n_right").alias("both"),
    )


def diff_summary(diff: DataFrame) -> DataFrame:
    """One row: sizes, differing rows per side, and whether the tables are equal multisets."""
    return diff.agg(
        F.coalesce(F.sum("n_left"), F.lit(0)).cast("bigint").alias("n_left"),
        F.coalesce(F.sum("n_right"), F.lit(0)).cast("bigint").alias("n_right"),
        F.coalesce(F.sum("only_left"), F.lit(0)).cast("bigint").alias("only_left"),
        F.coalesce(F.sum("only_right"), F.lit(0)).cast("bigint").alias("only_right"),
        F.coalesce(F.sum("both"), F.lit(0)).cast("bigint").alias("both"),
    ).withColumn("equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that stands for a result as an unordered multiset: its rows and two sums of their hashes.

    Null and empty cells differ; the hashes of a row are those of its cells as text, in order.
    """
    cells = [F.col(f"`{c}`").cast("string") for c in df.columns]
    known = [c.isNull() for c in cells]
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(salt), *cells, *known).cast("decimal(20,0)")), F.lit(0)) for salt in (1, 2)]
    return df.agg(F.count("*").alias("n"), *[s.cast("string").alias(f"h{i}") for i, s in enumerate(sums)])


def deterministic(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two executions of one statement compared as unordered multisets, over all rows.

    Each side's fingerprint is a job of its own: within one plan Spark would
    run what both sides share once and hand it to both.
    """
    a, b = fingerprint(first).first(), fingerprint(second).first()
    return first.sparkSession.createDataFrame([(a == b, a["n"], b["n"])], "sql_deterministic boolean, n_left bigint, n_right bigint")


