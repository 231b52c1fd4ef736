"""Profiles of source tables and the text documents built from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from queue import SimpleQueue

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

from ..functions.frames import ranked
from ..functions.text import col_of, sql_identifiers, strip
from ..session import scratch_path

# --- fixed values -----------------------------------------------------------
SKIP_TYPES = ("struct", "map", "array", "double", "float", "timestamp", "binary", "variant", "interval")
ACCEPT_TYPES = ("string", "boolean", "date", "tinyint", "smallint", "int", "bigint", "decimal", "long")
RANGE_TYPES = ("date", "timestamp")
VALUE_CAP = 30
JOIN_NAME_EXCLUDED = ("id", "name", "date", "value", "type", "status")
JOIN_NAME_CAP = 15
CURATED_CAP, HISTORY_CAP = 20, 5
QUESTION_CUT, SQL_CUT = 200, 160
# ----------------------------------------------------------------------------

#: Rows in which a column may show that it holds too many values.
PROBE = 1_000

CATALOG_SCHEMA = "table string, position int, column string, type string, comment string"


def column_catalog(tables: dict[str, DataFrame], spark: SparkSession) -> DataFrame:
    """Column names, types and comments of file tables, read from their schemas alone."""
    rows = [
        (t, i, f.name, f.dataType.simpleString(), (f.metadata or {}).get("comment", ""))
        for t, df in tables.items()
        for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, CATALOG_SCHEMA)


def describe_columns(spark: SparkSession, table: str) -> DataFrame:
    """The same for a catalog table; the column section ends at the first ``#`` header."""
    found, comment = [], ""
    in_columns = True
    for r in spark.sql(f"DESCRIBE TABLE EXTENDED {table}").toLocalIterator():
        name = (r["col_name"] or "").strip()
        if name.startswith("#"):
            in_columns = False
        elif name and in_columns:
            found.append((table, len(found), name, r["data_type"], r["comment"] or ""))
        elif name.lower() == "comment":
            comment = r["data_type"] or ""
    return spark.createDataFrame(found, CATALOG_SCHEMA).withColumn("table_comment", F.lit(comment))


def _any_in(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def column_eligibility(catalog: DataFrame) -> DataFrame:
    """Which columns are sampled for values and which give a range; skips win over accepts."""
    t = F.lower(F.col("type"))
    return catalog.withColumn("sampled", ~_any_in(t, SKIP_TYPES) & _any_in(t, ACCEPT_TYPES)).withColumn(
        "ranged", _any_in(t, RANGE_TYPES)
    )


def _sampled(schema: StructType) -> list[str]:
    return [
        f.name
        for f in schema.fields
        if not any(s in f.dataType.simpleString() for s in SKIP_TYPES)
        and any(s in f.dataType.simpleString() for s in ACCEPT_TYPES)
    ]


def _ranged(schema: StructType) -> list[str]:
    return [f.name for f in schema.fields if any(s in f.dataType.simpleString() for s in RANGE_TYPES)]


def open_tables(spark: SparkSession, paths: dict[str, str]) -> dict[str, DataFrame | None]:
    """Parquet tables by path; an unreadable one maps to None instead of failing the run."""
    from pyspark.errors import AnalysisException

    out: dict[str, DataFrame | None] = {}
    for name, path in paths.items():
        try:
            out[name] = spark.read.parquet(path)
        except AnalysisException:
            out[name] = None
    return out


def resolve_tables(wanted: DataFrame, registered: DataFrame, profiled: DataFrame, by: list[str]) -> DataFrame:
    """Tables to evaluate per group: the explicit list, else all registered; unread ones are marked dropped.

    ``wanted`` and ``registered`` are ``(by…, table)``, ``profiled`` is
    ``(table, row_count)``.
    """
    keys = [*by, "table"]
    explicit = wanted.select(*keys).distinct()
    fallback = registered.select(*keys).distinct().join(explicit.select(*by).distinct(), by, "left_anti")
    readable = profiled.where(F.col("row_count") >= 0).select("table").distinct().withColumn("_ok", F.lit(True))
    return (
        explicit.unionByName(fallback)
        .join(readable, "table", "left")
        .select(*keys, F.coalesce("_ok", F.lit(False)).alias("kept"))
    )


def require_tables(resolved: DataFrame, by: list[str], fail: bool = True) -> DataFrame:
    """``(by…, table, error)``: the kept tables; a group that lost every table fails the job.

    With ``fail`` false such a group is a row without a table that says so, and
    the other groups go on.  ``resolved`` is read twice, so pass it written
    where it is costly.
    """
    none = F.lit("no readable table left")
    lost = resolved.groupBy(*by).agg(F.count_if("kept").alias("n_kept")).where("n_kept = 0")
    error = F.raise_error(none).cast("string") if fail else none
    name = F.lit(None).cast(resolved.schema["table"].dataType).alias("table")
    kept = resolved.where("kept").select(*by, "table", F.lit("").alias("error"))
    return kept.unionByName(lost.select(*by, name, error.alias("error")))


class _Bounded:
    """The distinct values of some columns of one task: exact up to ``cap``, then only that there are more."""

    def __init__(self, names: list[str], cap: int):
        self.cap, self.values = cap, {c: set() for c in names}

    def add(self, batch: pa.RecordBatch) -> None:
        for c, seen in self.values.items():
            if len(seen) <= self.cap:
                new = pc.unique(batch.column(c)).drop_null()
                # any cap + 1 values show that there are more
                seen.update(new[: len(seen) + self.cap + 1].to_pylist())

    def rows(self) -> pa.RecordBatch:
        found = [(c, v, False) for c, seen in self.values.items() if len(seen) <= self.cap for v in seen]
        found += [(c, None, True) for c, seen in self.values.items() if len(seen) > self.cap]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found) if found else ((), (), ()), (pa.string(), pa.string(), pa.bool_()))], ["column", "value", "over"])


def bounded_values(df: DataFrame, names: list[str], cap: int = VALUE_CAP) -> DataFrame:
    """``(column, value)`` of the columns with 1 to ``cap`` distinct values, counted exactly in one pass.

    A task holds at most ``cap`` values a column, or the fact that it has seen
    more; it hands on that much, whatever the table holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Bounded(names, cap)
        for batch in batches:
            kept.add(batch)
        yield kept.rows()

    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in names])
    found = texts.mapInArrow(run, "column string, value string, over boolean").distinct()
    each = found.groupBy("column").agg(F.count("value").alias("n"), F.bool_or("over").alias("over"))
    return found.join(each.where(f"not over and n between 1 and {cap}"), "column").select("column", "value")


def _may_qualify(df: DataFrame, names: list[str], cap: int) -> list[str]:
    """Columns that ``PROBE`` of their rows do not already show to hold more than ``cap`` values; what some rows hold, all do."""
    probe = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in names]).limit(PROBE)
    counts = probe.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(names)]).first()
    return [c for i, c in enumerate(names) if counts[i] <= cap]


def low_card_values(df: DataFrame, cap: int = VALUE_CAP) -> DataFrame:
    """``(column, value)`` of every eligible column with 1 to ``cap`` distinct values, exactly.

    Most columns are ruled out by proof: a bounded number of rows already holds
    more values.  The rest is read once, with at most ``cap`` values a column
    kept by a task.  Keys and free text with billions of values are never
    exploded, shuffled or sketched.
    """
    names = _sampled(df.schema)
    few = _may_qualify(df, names, cap) if names else []
    if not few:
        return df.sparkSession.createDataFrame([], "column string, value string")
    return bounded_values(df, few, cap)


def _profiled(tables: Mapping[str, DataFrame], one: Callable[[DataFrame], DataFrame], schema: str, threads: int) -> DataFrame:
    """``one`` of every table, each written as it is done to one shared table; the plan of what is returned does not grow with the tables."""
    names = list(tables)
    if not names:
        raise ValueError("no table to profile")
    spark = tables[names[0]].sparkSession
    path = scratch_path(spark, "profiles")
    spark.createDataFrame([], schema).write.parquet(f"{path}/none")
    # a writer has a folder to itself, or writers would clear each other's unfinished files
    slots: SimpleQueue = SimpleQueue()
    for i in range(threads):
        slots.put(i)

    def write(name: str) -> None:
        slot = slots.get()
        try:
            one(tables[name]).select(F.lit(name).alias("table"), "*").write.mode("append").parquet(f"{path}/{slot}")
        finally:
            slots.put(slot)

    with ThreadPoolExecutor(threads) as pool:
        list(pool.map(write, names))
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path)


def profile_tables(tables: Mapping[str, DataFrame], cap: int = VALUE_CAP, threads: int = 8) -> DataFrame:
    """``(table, column, value)`` over any number of tables; a small pool keeps a few tables in flight."""
    return _profiled(tables, lambda df: low_card_values(df, cap), "table string, column string, value string", threads)


def profile_ranges(tables: Mapping[str, DataFrame], threads: int = 8) -> DataFrame:
    """``(table, column, lo, hi)`` over any number of tables."""
    return _profiled(tables, date_ranges, "table string, column string, lo string, hi string", threads)


def table_counts(tables: Mapping[str, DataFrame | None], spark: SparkSession, threads: int = 8) -> DataFrame:
    """``(table, row_count)`` over any number of tables; -1 where one could not be opened."""
    lost = spark.createDataFrame([(t, -1) for t, df in tables.items() if df is None], "table string, row_count bigint")
    opened = {t: df for t, df in tables.items() if df is not None}
    if not opened:
        return lost
    return lost.unionByName(_profiled(opened, lambda df: df.agg(F.count("*").alias("row_count")), "table string, row_count bigint", threads))


def date_ranges(df: DataFrame) -> DataFrame:
    """``(column, lo, hi)`` of every date or timestamp column that holds a value, in one aggregation."""
    names = _ranged(df.schema)
    if not names:
        return df.sparkSession.createDataFrame([], "column string, lo string, hi string")
    one = df.agg(
        *[F.min(F.col(f"`{c}`")).cast("string").alias(f"a{i}") for i, c in enumerate(names)],
        *[F.max(F.col(f"`{c}`")).cast("string").alias(f"b{i}") for i, c in enumerate(names)],
    )
    rows = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"a{i}").alias("lo"), F.col(f"b{i}").alias("hi")) for i, c in enumerate(names)]
    )
    return one.select(F.inline(rows)).where(F.col("lo").isNotNull())


def sample_lines(values: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """Text block per table: value lists sorted as strings, then date ranges.

    Value lists hold at most the sampling cap per column, so a block is
    bounded by the width of its table.
    """
    lists = values.groupBy(*by, "column").agg(F.array_sort(F.collect_set("value")).alias("v")).select(
        *by, F.lit(0).alias("k"), "column",
        F.concat(F.lit("  - "), "column", F.lit(": ['"), F.array_join("v", "', '"), F.lit("']")).alias("line"),
    )
    spans = ranges.select(
        *by, F.lit(1).alias("k"), "column",
        F.concat(F.lit("  - "), "column", F.lit(": date range "), "lo", F.lit(" .. "), "hi").alias("line"),
    )
    return _ordered_text(lists.unionByName(spans), by, ["k", "column"], "line", "column_samples")


def _ordered_text(df: DataFrame, by: list[str], order: list[str], line: str, name: str, sep: str = "\n") -> DataFrame:
    """Lines of a small, already capped group joined in order."""
    packed = F.array_sort(F.collect_list(F.struct(*order, F.col(line).alias("_line"))))
    return df.groupBy(*by).agg(packed.alias("_p")).select(*by, F.array_join(F.col("_p._line"), sep).alias(name))


def declared_fks(tc: DataFrame, kcu: DataFrame, rc: DataFrame, ccu: DataFrame) -> DataFrame:
    """Foreign keys from the four constraint views, by catalog, schema and name.

    Every join starts from the filtered foreign keys and carries full
    equality keys, so each step shrinks or keeps its input.
    """
    key = ["constraint_catalog", "constraint_schema", "constraint_name"]
    fk = tc.where(F.col("constraint_type") == "FOREIGN KEY").select(*key, "table_schema", "table_name")
    uses = kcu.select(*key, F.col("column_name").alias("fk_col"))
    refs = rc.select(
        *key,
        F.col("unique_constraint_catalog").alias("_uc"),
        F.col("unique_constraint_schema").alias("_us"),
        F.col("unique_constraint_name").alias("_un"),
    )
    target = ccu.select(
        F.col("constraint_catalog").alias("_uc"),
        F.col("constraint_schema").alias("_us"),
        F.col("constraint_name").alias("_un"),
        F.concat_ws(".", "table_catalog", "table_schema", "table_name").alias("ref_table"),
        F.col("column_name").alias("ref_col"),
    )
    return (
        fk.join(refs, key).join(target, ["_uc", "_us", "_un"]).join(uses, key)
        .select("table_schema", "table_name", "fk_col", "ref_table", "ref_col")
    )


def shared_columns(catalog: DataFrame, by: list[str] | None = None, cap: int | None = JOIN_NAME_CAP) -> DataFrame:
    """``(by…, column, n_tables, table)``: names found in two or more tables, candidate join columns.

    The cap keeps the names seen first in catalog order (table, then
    position).  Rows stay long, one per name and table, so a name that a
    third of all tables share is never gathered into one value.
    """
    by = list(by or [])
    keys = [*by, "column"]
    c = catalog.select(*by, F.lower("column").alias("column"), "table", "position")
    pairs = c.where(~F.col("column").isin(*JOIN_NAME_EXCLUDED)).groupBy(*keys, "table").agg(F.min("position").alias("position"))
    per = (
        pairs.groupBy(*keys)
        .agg(F.count("*").alias("n_tables"), F.min(F.struct("table", "position")).alias("_seen"))
        .where(F.col("n_tables") >= 2)
    )
    if cap is not None:
        per = first_rows(per, by, ["_seen", "column"], cap).drop("_rn")
    return pairs.join(per.select(*keys, "n_tables"), keys).select(*keys, "n_tables", "table")


def used_columns(items: DataFrame, catalog: DataFrame, by: list[str] | None = None, sql: str = "expected_sql") -> DataFrame:
    """Known columns, lower case, with a flag whether any item's SQL names them.

    Words are made distinct per task before the shuffle, so common words cost
    one row per task, not one per item.
    """
    by = list(by or [])
    words = items.select(*by, F.explode(sql_identifiers(sql)).alias("column")).distinct()
    known = catalog.select(*by, F.lower("column").alias("column")).distinct()
    return known.join(words.withColumn("_u", F.lit(True)), [*by, "column"], "left").select(
        *by, "column", F.coalesce("_u", F.lit(False)).alias("used")
    )


def column_coverage(items: DataFrame, catalog: DataFrame, by: list[str] | None = None) -> DataFrame:
    u = used_columns(items, catalog, by)
    return u.groupBy(*(by or [])).agg(
        F.count("*").alias("n_columns"),
        F.count_if("used").alias("n_used"),
        F.round(F.avg(F.col("used").cast("int")), 3).alias("column_coverage"),
    )


def first_rows(df: DataFrame, by: list[str], order: list, cap: int) -> DataFrame:
    """The first ``cap`` rows of each group.

    Spark limits each task to ``cap`` rows per group before the shuffle, so a
    huge group sends only ``cap`` rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_rn", rank).where(F.col("_rn") <= cap)


def curated_lines(curated: DataFrame, by: list[str], order: str = "pos", cap: int = CURATED_CAP) -> DataFrame:
    """The first curated questions of a space as a list; blank ones use up a place but print nothing."""
    top = first_rows(curated.select(*by, order, "text"), by, [order], cap)
    lines = top.where(F.coalesce(F.col("text"), F.lit("")) != "").withColumn("line", F.concat(F.lit("  - "), "text"))
    return _ordered_text(lines, by, ["_rn"], "line", "curated_block")


def history_lines(history: DataFrame, by: list[str], order: str = "pos", cap: int = HISTORY_CAP) -> DataFrame:
    """Failed questions first, up to the cap, then completed ones in the places left."""
    h = history.where(F.col("status").isin("FAILED", "COMPLETED")).select(
        *by, order, (F.col("status") == "COMPLETED").cast("int").alias("done"),
        F.substring("question", 1, QUESTION_CUT).alias("q"),
        F.substring(strip(F.regexp_replace(F.coalesce("answer_sql", F.lit("")), r"(?U)\s+", " ")), 1, SQL_CUT).alias("s"),
    )
    top = first_rows(h, by, ["done", order], cap)
    line = F.when(F.col("done") == 0, F.concat(F.lit("  - [KNOWN GAP] "), "q")).otherwise(
        F.concat(F.lit("  - "), "q", F.lit("  -- answered with: "), "s")
    )
    return _ordered_text(top.withColumn("line", line), by, ["_rn"], "line", "history_block")


def fk_lines(fks: DataFrame, by: list[str]) -> DataFrame:
    lines = fks.withColumn(
        "line", F.concat(F.lit("  - "), "from_table", F.lit("."), "fk_col", F.lit(" → "), "ref_table", F.lit("."), "ref_col")
    )
    return _ordered_text(lines, by, ["from_table", "fk_col", "ref_table", "ref_col"], "line", "fk_block")


def shared_lines(shared: DataFrame, by: list[str]) -> DataFrame:
    named = _ordered_text(shared, [*by, "column"], ["table"], "table", "tables", ", ")
    lines = named.withColumn("line", F.concat(F.lit("  - `"), "column", F.lit("` appears in: "), "tables"))
    return _ordered_text(lines, by, ["column"], "line", "shared_block")


SINGLE_TABLE_NOTE = (
    "Only one table is in scope. Vary time grain, filter column, depth of aggregation and ranking metric, "
    "so that no two questions differ in a column name alone."
)


def _section(head: str, body: str) -> Column:
    return F.when(F.coalesce(F.col(body), F.lit("")) != "", F.concat(F.lit(head), F.col(body)))


def context_document(
    spaces: DataFrame,
    by: list[str],
    curated: DataFrame | None = None,
    history: DataFrame | None = None,
    fks: DataFrame | None = None,
    shared: DataFrame | None = None,
    extra: str = "",
) -> DataFrame:
    """One context text per space, sections joined by blank lines.

    ``spaces`` is ``(by…, title, description, instructions, n_tables)``.
    Curated examples appear only where there are several tables, inferred join
    columns only where none is declared, single-table guidance only where
    there is one table.  Only the curated and history blocks are capped per space;
    foreign keys and shared names are joined whole.
    """
    doc = spaces
    for block, df in (
        ("curated_block", curated_lines(curated, by) if curated is not None else None),
        ("history_block", history_lines(history, by) if history is not None else None),
        ("fk_block", fk_lines(fks, by) if fks is not None else None),
        ("shared_block", shared_lines(shared, by) if shared is not None else None),
    ):
        doc = doc.join(df, by, "left") if df is not None else doc.withColumn(block, F.lit(None).cast("string"))
    many = F.col("n_tables") > 1
    parts = [
        F.concat(F.lit("Space title: "), F.coalesce("title", F.lit(""))),
        F.concat(F.lit("Space description: "), F.coalesce("description", F.lit(""))),
        _section("Space instructions:\n", "instructions"),
        F.when(many, _section("CURATED QUESTIONS (style to follow, not to copy):\n", "curated_block")),
        _section("Questions from history (vocabulary only):\n", "history_block"),
        F.when(
            F.coalesce(F.col("fk_block"), F.lit("")) != "", _section("Declared join paths:\n", "fk_block")
        ).otherwise(F.when(many, _section("Join columns inferred from shared names:\n", "shared_block"))),
        F.lit(f"Extra instructions:\n{extra}") if extra else F.lit(None).cast("string"),
        F.when(F.col("n_tables") == 1, F.lit(SINGLE_TABLE_NOTE)),
    ]
    return doc.select(*by, F.concat_ws("\n\n", *parts).alias("context"))


def solver_context(profiles: DataFrame, by: list[str], instructions: DataFrame | None = None, curated: DataFrame | None = None) -> DataFrame:
    """What a solver sees: schema and samples of each table, instructions, curated questions.

    ``profiles`` is ``(by…, table, schema_text, column_samples)``.
    """
    blocks = profiles.withColumn(
        "line",
        F.concat(F.lit("TABLE "), "table", F.lit("\n"), "schema_text", F.lit("\nsample values:\n"), "column_samples"),
    )
    doc = _ordered_text(blocks, by, ["table"], "line", "tables_block", "\n\n")
    doc = doc.join(instructions, by, "left") if instructions is not None else doc.withColumn("instructions", F.lit(None).cast("string"))
    doc = doc.join(curated_lines(curated, by), by, "left") if curated is not None else doc.withColumn("curated_block", F.lit(None).cast("string"))
    return doc.select(
        *by,
        F.concat_ws(
            "\n\n", "tables_block",
            _section("SPACE INSTRUCTIONS:\n", "instructions"),
            _section("CURATED EXAMPLE QUESTIONS:\n", "curated_block"),
        ).alias("context"),
    )


def _part(*keys) -> Column:
    """A row's place in its section; numbers sort as text of one length."""
    return F.array(*[F.lpad(k.cast("string"), 12, "0") if isinstance(k, Column) else F.col(k).cast("string") for k in keys]).alias("part")


def _with_head(section: int, head: str, lines: DataFrame, by: list[str]) -> DataFrame:
    """(by…, section, part, text) of a section's lines under its head; a blank line comes before the head."""
    heads = lines.select(*by).distinct().select(*by, F.lit(section).alias("section"), F.array().cast("array<string>").alias("part"), F.lit(f"\n{head}").alias("text"))
    return heads.unionByName(lines.select(*by, F.lit(section).alias("section"), "part", "text"))


def _one_line(spaces: DataFrame, by: list[str], section: int, text: Column) -> DataFrame:
    rows = spaces.select(*by, F.lit(section).alias("section"), F.array().cast("array<string>").alias("part"), text.alias("text"))
    return rows.where(F.col("text").isNotNull())


def _curated_rows(curated: DataFrame, by: list[str], order: str = "pos") -> DataFrame:
    top = first_rows(curated.select(*by, order, "text"), by, [order], CURATED_CAP).where(F.coalesce("text", F.lit("")) != "")
    return top.select(*by, _part(F.col("_rn")), F.concat(F.lit("  - "), "text").alias("text"))


def context_sections(
    spaces: DataFrame,
    by: list[str],
    curated: DataFrame | None = None,
    history: DataFrame | None = None,
    fks: DataFrame | None = None,
    shared: DataFrame | None = None,
    extra: str = "",
) -> DataFrame:
    """The context document as rows ``(by…, section, part, text)``; a space with a third of all tables is many rows, no value.

    Their texts, in the order of section and part and joined by line ends, are
    what ``context_document`` joins for small spaces.
    """
    title, about = (F.concat(F.lit(f"{head}: "), F.coalesce(c, F.lit(""))) for head, c in (("Space title", "title"), ("Space description", "description")))
    parts = [
        _one_line(spaces, by, 0, title),
        _one_line(spaces, by, 1, F.concat(F.lit("\n"), about)),
        _one_line(spaces, by, 2, F.concat(F.lit("\n"), _section("Space instructions:\n", "instructions"))),
        _one_line(spaces, by, 7, F.when(F.col("n_tables") == 1, F.lit(f"\n{SINGLE_TABLE_NOTE}"))),
    ]
    many = spaces.where("n_tables > 1").select(*by)
    if curated is not None:
        parts.append(_with_head(3, "CURATED QUESTIONS (style to follow, not to copy):", _curated_rows(curated, by).join(many, by, "left_semi"), by))
    if history is not None:
        # five lines at most
        block = history_lines(history, by).join(spaces.select(*by), by, "left_semi").where("history_block <> ''")
        parts.append(_with_head(4, "Questions from history (vocabulary only):", block.select(*by, F.array(F.lit("0")).alias("part"), F.col("history_block").alias("text")), by))
    if fks is not None:
        text = F.concat(F.lit("  - "), "from_table", F.lit("."), "fk_col", F.lit(" → "), "ref_table", F.lit("."), "ref_col").alias("text")
        declared = fks.join(spaces.select(*by), by, "left_semi")
        parts.append(_with_head(5, "Declared join paths:", declared.select(*by, _part("from_table", "fk_col", "ref_table", "ref_col"), text), by))
    if shared is not None:
        inferred = shared.join(many, by, "left_semi")
        inferred = inferred.join(fks.select(*by).distinct(), by, "left_anti") if fks is not None else inferred
        named = _ordered_text(inferred, [*by, "column"], ["table"], "table", "tables", ", ")
        text = F.concat(F.lit("  - `"), "column", F.lit("` appears in: "), "tables").alias("text")
        parts.append(_with_head(5, "Join columns inferred from shared names:", named.select(*by, _part("column"), text), by))
    if extra:
        parts.append(_one_line(spaces, by, 6, F.lit(f"\nExtra instructions:\n{extra}")))
    return reduce(DataFrame.unionByName, parts)


def solver_sections(profiles: DataFrame, by: list[str], instructions: DataFrame | None = None, curated: DataFrame | None = None) -> DataFrame:
    """The solver's context as rows ``(by…, section, part, text)``, one for each table, for the instructions and for each curated question."""
    block = F.concat(F.lit("TABLE "), "table", F.lit("\n"), "schema_text", F.lit("\nsample values:\n"), "column_samples")
    # a blank line stands between tables
    first = profiles.groupBy(*by).agg(F.min("table").alias("_first"))
    tables = profiles.join(first, by).withColumn("text", F.when(F.col("table") == F.col("_first"), block).otherwise(F.concat(F.lit("\n"), block)))
    parts = [tables.select(*by, F.lit(0).alias("section"), _part("table"), "text")]
    if instructions is not None:
        own = instructions.join(first.select(*by), by, "left_semi").where(F.coalesce("instructions", F.lit("")) != "")
        parts.append(_one_line(own, by, 1, F.concat(F.lit("\nSPACE INSTRUCTIONS:\n"), "instructions")))
    if curated is not None:
        parts.append(_with_head(2, "CURATED EXAMPLE QUESTIONS:", _curated_rows(curated, by).join(first.select(*by), by, "left_semi"), by))
    return reduce(DataFrame.unionByName, parts)


def document_lines(sections: DataFrame, by: list[str]) -> DataFrame:
    """``(by…, line_no, line)`` of documents in sections, numbered from 1; the order is found by a distributed sort."""
    lines = sections.select(*by, "section", "part", F.posexplode(F.split("text", "\n")).alias("_k", "line"))
    numbered = ranked(lines, by, ["section", "part", "_k"], "document-lines")
    return numbered.select(*by, (F.col("rank") + 1).alias("line_no"), "line")


def write_documents(sections: DataFrame, by: list[str], path: str) -> None:
    """Documents as ordered lines, a space's part files in the order of their names; whoever reads a file puts it together."""
    lines = document_lines(sections, by)
    lines.repartitionByRange(*by, "line_no").sortWithinPartitions(*by, "line_no").write.mode("overwrite").parquet(path)


def schema_text(catalog: DataFrame, by: list[str]) -> DataFrame:
    """Schema lines per table in column order."""
    note = F.coalesce(F.col("comment"), F.lit(""))
    lines = catalog.withColumn(
        "line",
        F.concat(F.lit("  - "), "column", F.lit(": "), "type", F.when(note != "", F.concat(F.lit("  -- "), note)).otherwise("")),
    )
    return _ordered_text(lines, by, ["position"], "line", "schema_text")
