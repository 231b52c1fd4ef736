"""Statements of one form in one pass over the rows that they read.

Statements that differ in compared values only have one plan but for a filter.
Where that plan filters rows by those values and then makes one row of them
(aggregates without groups) or takes the first, Spark's optimised plan of one
statement is taken apart at the filter.  Equalities become a join with the
values.  A bound (``>`` and the like) deals each row to its gap between the
sorted values, and a statement's result is put together from the gaps on its
side.  The rows are read once for all statements, and no pair of a statement
and a row that is not among those it takes in is looked at.

What aggregates take in, and what is made of them, is computed under Spark's
``TryEval``: a row that it fails on ends the statements that take that row in,
and no others.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

_EXPRESSIONS = "org.apache.spark.sql.catalyst.expressions"
_COMPARED = {"=": "EqualTo", "==": "EqualTo", ">": "GreaterThan", ">=": "GreaterThanOrEqual", "<": "LessThan", "<=": "LessThanOrEqual"}
#: How a row's place among the sorted values is found for a bound: which side equal values lie on, what is added, and whether later places take a row in.
_BOUNDS = {">": ("left", -1, False), ">=": ("right", -1, False), "<": ("right", 0, True), "<=": ("left", 0, True)}
#: Aggregates whose results over parts give the result over the whole, and how.
_MERGED = {"Count": F.sum, "Sum": F.sum, "Min": F.min, "Max": F.max}
#: Stands for a value while the plan is looked at; small enough for an INT.
MARK = 987_654_321


@dataclass
class Shape:
    """A form's plan, taken apart at the filter by its values."""

    below: DataFrame
    rest: list[Column]
    #: what is compared, how, and with which type, for each value that differs
    asked: list[tuple[Column, str, str]]
    #: projections over the filter, then those over a sort
    inner: list[list]
    outer: list[list]
    order: list[Column]
    #: the aggregates' row, or None where the first row is the result
    made: list | None


def _list(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _seq(spark: SparkSession, items: list):
    return spark._jvm.PythonUtils.toSeq(items)


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _column(spark: SparkSession, expression) -> Column:
    return Column(spark._jvm.org.apache.spark.sql.classic.ExpressionUtils.column(expression))


def _expression(spark: SparkSession, column: Column):
    return spark._jvm.org.apache.spark.sql.classic.ExpressionUtils.expression(column._jc)


def _jvm(spark: SparkSession, name: str):
    node = spark._jvm
    for part in f"{_EXPRESSIONS}.{name}".split("."):
        node = getattr(node, part)
    return node


def _tried(spark: SparkSession, expressions: list) -> Column:
    """The values as a struct, null if one of them fails."""
    named = [x for k, e in enumerate(expressions) for x in (_expression(spark, F.lit(f"v{k}")), e)]
    return _column(spark, _jvm(spark, "TryEval")(_jvm(spark, "CreateNamedStruct")(_seq(spark, named))))


def _is_mark(e, mark: int | str) -> bool:
    if _kind(e) != "Literal":
        return False
    value = e.value()
    if isinstance(mark, int):
        return isinstance(value, int | float) and not isinstance(value, bool) and value == mark
    return value is not None and e.dataType().simpleString() == "string" and value.toString() == mark


def _count(plan, marks: list[int | str]) -> int:
    """How often the marks stand in a plan."""
    found, nodes = 0, [plan]
    while nodes:
        node = nodes.pop()
        nodes += _list(node.children())
        todo = _list(node.expressions())
        while todo:
            e = todo.pop()
            todo += _list(e.children())
            found += any(_is_mark(e, m) for m in marks)
    return found


def _whole(plan) -> bool:
    """Whether every table is read by files that no filter has chosen yet, or is no table of files."""
    for leaf in _list(plan.collectLeaves()):
        if _kind(leaf) == "LogicalRelation":
            table = leaf.relation()
            if _kind(table) != "HadoopFsRelation" or not leaf.catalogTable().isEmpty() and table.partitionSchema().size():
                return False
        elif _kind(leaf) not in ("LogicalRDD", "Range", "InMemoryRelation"):
            return False
    return True


def _filtered(plan, column) -> int:
    """How often a plan's filters and joins use a column."""
    found, nodes = 0, [plan]
    while nodes:
        node = nodes.pop()
        nodes += _list(node.children())
        todo = _list(node.expressions()) if _kind(node) in ("Filter", "Join") else []
        while todo:
            e = todo.pop()
            todo += _list(e.children())
            found += _kind(e) == "AttributeReference" and e.exprId().equals(column.exprId())
    return found


def _conjuncts(e) -> list:
    return [x for side in _list(e.children()) for x in _conjuncts(side)] if _kind(e) == "And" else [e]


def differing(form: str, values: list[tuple[str, ...]]) -> tuple[str, dict[int, tuple[str, str]]]:
    """The form with the values that all share put back, and of each other value its operator and kind (``n`` or ``s``)."""
    found = {int(k): (op, kind) for op, k, kind in re.findall(r"(<=>|<=|>=|<>|!=|==|=|<|>) asked\.p(\d+)([ns])", form)}
    differ = {k: found[k] for k in sorted(found) if len({v[k] for v in values}) > 1}
    return re.sub(r"asked\.p(\d+)[ns]", lambda m: m[0] if int(m[1]) in differ else values[0][int(m[1])], form), differ


def shape_of(spark: SparkSession, form: str, differ: dict[int, tuple[str, str]]) -> Shape | None:
    """How the form's statements can be run in one pass; None if they are not known to be."""
    ops = [op for op, _ in differ.values()]
    if not differ or not (all(op in ("=", "==") for op in ops) or len(ops) == 1 and ops[0] in _BOUNDS):
        return None
    marks = {k: MARK - k if kind == "n" else f"asked value {k}" for k, (_, kind) in differ.items()}
    sql = re.sub(r"asked\.p(\d+)([ns])", lambda m: str(marks[int(m[1])]) if m[2] == "n" else f"'{marks[int(m[1])]}'", form)
    ran = spark.sql(sql)._jdf.queryExecution()
    plan = ran.optimizedPlan()
    if not plan.deterministic() or not plan.subqueriesAll().isEmpty() or _count(plan, list(marks.values())) != len(marks) or not _whole(plan):
        return None

    def projections(node) -> tuple[list[list], object]:
        """The projections above what is no projection, from below, and that."""
        found = []
        while _kind(node) == "Project":
            found.insert(0, _list(node.projectList()))
            node = node.child()
        return found, node

    node, made, order, outer = plan, None, [], []
    while _kind(node) in ("GlobalLimit", "LocalLimit"):
        if _kind(node.limitExpr()) != "Literal" or node.limitExpr().value() < 1:
            return None
        node = node.child()
    if _kind(node) == "Aggregate":
        if not node.groupingExpressions().isEmpty():
            return None
        made, node = _list(node.aggregateExpressions()), node.child()
        inner, node = projections(node)
    else:
        inner, node = projections(node)
        if _kind(node) == "Sort" and getattr(node, "global")():
            for by in _list(node.order()):
                way = f"{by.direction().sql().lower()}_{by.nullOrdering().sql().lower().replace(' ', '_')}"
                order.append(getattr(_column(spark, by.child()), way)())
            outer = inner
            inner, node = projections(node.child())
    if _kind(node) != "Filter":
        return None
    asked, rest = {}, []
    for e in _conjuncts(node.condition()):
        for k, mark in marks.items():
            if _kind(e) == _COMPARED[differ[k][0]] and _is_mark(e.right(), mark):
                # Spark puts an equal value in the column's place in other conditions, and the mark could decide those
                if any(_filtered(ran.analyzed(), c) != 1 for c in _list(e.left().references().toSeq())):
                    return None
                asked[k] = (_column(spark, e.left()), differ[k][0], e.right().dataType().simpleString())
                break
        else:
            rest.append(_column(spark, e))
    types = ("int", "bigint", "double") if ops[0] in _BOUNDS else ("int", "bigint", "double", "string")
    if set(asked) != set(marks) or any(t not in types for _, _, t in asked.values()):
        return None
    below = DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, node.child()), spark)
    if made is None and not outer:
        outer = [_list(plan.output())]
    return Shape(below, rest, [asked[k] for k in sorted(asked)], inner, outer, order, made)


class _Row:
    """The row that a form's aggregates make: what they take in, the aggregates, and what is made of them."""

    def __init__(self, spark: SparkSession, made: list):
        self.spark, self.found, self.known = spark, [], True
        self.cells = [self._made(e.child() if _kind(e) == "Alias" else e) for e in made]
        self.known &= all(not a.isDistinct() and a.filter().isEmpty() and a.aggregateFunction().getClass().getName().startswith(f"{_EXPRESSIONS}.aggregate.") for a in self.found)

    def _made(self, e):
        """The expression over columns ``a0``, ``a1``, … in place of its aggregates."""
        if _kind(e) == "AggregateExpression":
            self.found.append(e)
            return _expression(self.spark, F.col(f"a{len(self.found) - 1}"))
        if _kind(e) == "AttributeReference":
            self.known = False
        children = _list(e.children())
        return e.withNewChildren(_seq(self.spark, [self._made(c) for c in children])) if children else e

    def taken(self) -> list[Column]:
        """What each aggregate takes in, as columns ``t0``, ``t1``, …, null where it fails."""
        return [_tried(self.spark, _list(a.aggregateFunction().children())).alias(f"t{k}") for k, a in enumerate(self.found)]

    def failing(self) -> Column:
        return F.count_if(F.coalesce(F.col("taken") & F.greatest(F.lit(False), F.lit(False), *[F.col(f"t{k}").isNull() for k in range(len(self.found))]), F.lit(False))).alias("bad")

    def aggregates(self) -> list[Column]:
        """The aggregates over the rows that are ``taken``."""
        spark, out = self.spark, []
        for k, a in enumerate(self.found):
            f = a.aggregateFunction()
            f = f.withNewChildren(_seq(spark, [c if c.foldable() else _expression(spark, F.col(f"t{k}.v{i}")) for i, c in enumerate(_list(f.children()))]))
            only = spark._jvm.scala.Option.apply(_expression(spark, F.col("taken")))
            out.append(_column(spark, _jvm(spark, "aggregate.AggregateExpression")(f, a.mode(), False, only, a.resultId())).alias(f"a{k}"))
        return out

    def merges(self) -> bool:
        return all(_kind(a.aggregateFunction()) in _MERGED for a in self.found)

    def merged(self, over) -> list[Column]:
        """The aggregates of a window over parts of the rows."""
        out = []
        for k, a in enumerate(self.found):
            whole = _MERGED[_kind(a.aggregateFunction())](f"a{k}").over(over).cast(a.aggregateFunction().dataType().sql())
            out.append((F.coalesce(whole, F.lit(0).cast("bigint")) if _kind(a.aggregateFunction()) == "Count" else whole).alias(f"a{k}"))
        return out

    def result(self, rows: DataFrame) -> DataFrame:
        """sql_id, the one row as text, and how much of it fails."""
        text = [_expression(self.spark, _column(self.spark, e).cast("string")) for e in self.cells]
        made = rows.select("sql_id", _tried(self.spark, text).alias("made"), "bad")
        cells = F.array(*[F.col(f"made.v{k}") for k in range(len(text))])
        return made.select("sql_id", F.array(cells).alias("rows"), (F.col("bad") + F.col("made").isNull().cast("int")).alias("bad"))


def _through(spark: SparkSession, rows: DataFrame, projections: list[list], *kept: str) -> DataFrame:
    for named in projections:
        rows = rows.select(*[_column(spark, e) for e in named], *kept)
    return rows


def _kept(shape: Shape) -> DataFrame:
    """The rows that the filter keeps whatever the values are."""
    rows = shape.below
    for e in shape.rest:
        rows = rows.where(e)
    return rows


def _first(spark: SparkSession, rows: DataFrame, shape: Shape, by: str) -> DataFrame:
    """The first row in the form's order for each value of ``by``, its cells as text, and its place in that order."""
    rows = _through(spark, rows, shape.inner, by)
    if shape.order:
        rows = rows.withColumn("asked_rank", F.row_number().over(Window.partitionBy(by).orderBy(*shape.order))).where("asked_rank = 1")
        if by == "asked_at":
            rows = rows.withColumn("asked_rank", F.row_number().over(Window.orderBy(*shape.order)))
    else:
        rows = rows.dropDuplicates([by]).withColumn("asked_rank", F.lit(1))
    width = len(shape.outer[-1])
    named = _through(spark, rows, shape.outer, by, "asked_rank").toDF(*[f"c{k}" for k in range(width)], by, "asked_rank")
    return named.select(by, "asked_rank", F.array(*[F.col(f"c{k}").cast("string") for k in range(width)]).alias("cells"))


def _equal(spark: SparkSession, shape: Shape, row: _Row | None, asked: list[tuple[str, tuple]]) -> DataFrame:
    values = spark.createDataFrame([(i, *v) for i, v in asked], ", ".join(["asked_id string", *[f"asked_v{k} {t}" for k, (_, _, t) in enumerate(shape.asked)]]))
    rows = _kept(shape).join(F.broadcast(values), [c == F.col(f"asked_v{k}") for k, (c, _, _) in enumerate(shape.asked)])
    ids = values.select(F.col("asked_id").alias("sql_id"))
    if row:
        rows = _through(spark, rows, shape.inner, "asked_id").select(F.col("asked_id").alias("sql_id"), F.lit(True).alias("taken"), *row.taken())
        # a statement that no row is for has a result too
        rows = rows.unionByName(ids.withColumn("taken", F.lit(False)), allowMissingColumns=True)
        return row.result(rows.groupBy("sql_id").agg(*row.aggregates(), row.failing()))
    first = _first(spark, rows, shape, "asked_id").select(F.col("asked_id").alias("sql_id"), "cells")
    return ids.join(first, "sql_id", "left").select("sql_id", _rows("cells"), F.lit(0).cast("bigint").alias("bad"))


def _rows(cells: str) -> Column:
    """No row or one."""
    return F.when(F.col(cells).isNull(), F.array().cast("array<array<string>>")).otherwise(F.array(cells)).alias("rows")


def _bounded(spark: SparkSession, shape: Shape, row: _Row | None, asked: list[tuple[str, tuple]]) -> DataFrame:
    (compared, op, kind), = shape.asked
    side, shift, later = _BOUNDS[op]
    sorted_values = np.array(sorted({v for _, (v,) in asked}), dtype="float64" if kind == "double" else "int64")
    at = {v: k for k, v in enumerate(sorted_values.tolist())}

    @F.pandas_udf("int")
    def place(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(sorted_values, x.to_numpy(), side) + shift)

    rows = _kept(shape)
    # rows beyond the loosest bound are in no statement; the others have a place
    loosest = F.lit(sorted_values[-1 if later else 0].item()).cast(kind)
    rows = rows.where({">": compared > loosest, ">=": compared >= loosest, "<": compared < loosest, "<=": compared <= loosest}[op])
    rows = rows.withColumn("asked_at", place(compared.cast("double" if kind == "double" else "bigint")))
    ids = spark.createDataFrame([(i, at[v]) for i, (v,) in asked], "sql_id string, asked_at int")
    # one row for each distinct value, in one task
    over = Window.orderBy(F.asc("asked_at") if later else F.desc("asked_at")).rowsBetween(Window.unboundedPreceding, 0)
    places = ids.select("asked_at").distinct()
    if row:
        rows = _through(spark, rows, shape.inner, "asked_at").select("asked_at", F.lit(True).alias("taken"), *row.taken())
        parts = rows.groupBy("asked_at").agg(*row.aggregates(), row.failing())
        parts = places.join(parts, "asked_at", "left")
        whole = parts.select("asked_at", *row.merged(over), F.coalesce(F.sum("bad").over(over), F.lit(0)).alias("bad"))
        return row.result(ids.join(whole, "asked_at"))
    parts = places.join(_first(spark, rows, shape, "asked_at"), "asked_at", "left")
    least = F.min(F.when(F.col("cells").isNotNull(), F.struct("asked_rank", "cells"))).over(over)
    whole = parts.select("asked_at", least.alias("least")).select("asked_at", F.col("least.cells").alias("cells"))
    return ids.join(whole, "asked_at").select("sql_id", _rows("cells"), F.lit(0).cast("bigint").alias("bad"))


def together(spark: SparkSession, form: str, asked: list[tuple[str, tuple[str, ...]]]) -> DataFrame | None:
    """sql_id, rows (none, or the first) and bad (how many rows it fails on) of a form's statements; None if the form is not known to allow it."""
    form, differ = differing(form, [values for _, values in asked])
    shape = shape_of(spark, form, differ)
    if shape is None:
        return None
    row = _Row(spark, shape.made) if shape.made is not None else None
    read = [lambda v, t=t: v[1:-1] if t == "string" else float(v) if t == "double" else int(v) for _, _, t in shape.asked]
    values = [(i, tuple(f(v[k]) for f, k in zip(read, differ))) for i, v in asked]
    bound = shape.asked[0][1] in _BOUNDS
    if row and not (row.known and (row.merges() or not bound)):
        return None
    return (_bounded if bound else _equal)(spark, shape, row, values)
