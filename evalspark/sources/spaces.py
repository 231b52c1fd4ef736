"""Tables partitioned by space: scoped reads, scoped replacement, logs and previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.text import is_blank, strip

# --- fixed values -----------------------------------------------------------
PREVIEW_MAX = 2000
PREVIEW_COLUMNS = ("question", "expected_sql", "category", "difficulty", "sql_executes", "n_result_rows")
_ESCAPED = "\"#%'*/:=?\\\x7f{[]^"
RUNS_INDEX_SCHEMA = (
    "run_id bigint, run_name string, space_id string, experiment_path string, "
    "submitted_at timestamp, submitted_by string, params_json string"
)
# ----------------------------------------------------------------------------


def read_items(spark: SparkSession, path: str, merge_schema: bool = False) -> DataFrame:
    """All spaces; ids are text as they were written (``007`` is not ``7``), whatever the folder names look like."""
    found = spark.read.option("mergeSchema", merge_schema).parquet(path).schema
    kinds = [T.StructField(f.name, T.StringType() if f.name == "space_id" else f.dataType) for f in found]
    return spark.read.schema(T.StructType(kinds)).parquet(path)


def read_space(spark: SparkSession, path: str, space_id, merge_schema: bool = False) -> DataFrame:
    """Only this space's rows; the filter prunes all other partitions."""
    return read_items(spark, path, merge_schema).where(F.col("space_id") == F.lit(str(space_id)))


def _folder(space_id: str) -> str:
    """The partition folder of a space, named as Spark names it."""
    return "space_id=" + "".join(f"%{ord(c):02X}" if ord(c) < 32 or c in _ESCAPED else c for c in space_id)


def replace_space(df: DataFrame, path: str, spaces: tuple[str, ...] = ()) -> None:
    """Replaces the partitions of the spaces in ``df`` and leaves all others alone.

    Dynamic partition overwrite commits whole partitions, so repeating a failed
    write is safe and never touches another space.  The rebalance hint gathers
    each space into few files and splits a space too large for one task.  A
    space named in ``spaces`` of which ``df`` has no row is emptied.
    """
    df.hint("rebalance", F.col("space_id")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("space_id").parquet(path)
    for space in spaces:
        own = df.where(F.col("space_id") == F.lit(space))
        if own.isEmpty():
            own.drop("space_id").write.mode("overwrite").parquet(f"{path}/{_folder(space)}")


def append_question_log(items: DataFrame, path: str) -> None:
    """Appends the questions of a run with the time of logging."""
    items.select("question_id", "question", "space_id").withColumn("logged_at", F.current_timestamp()).write.mode(
        "append"
    ).parquet(path)


def prior_questions(*sources: DataFrame | None) -> DataFrame:
    """Distinct trimmed, non-blank questions per space over all sources that exist."""
    have = [s.select("space_id", strip("question").alias("question")) for s in sources if s is not None]
    if not have:
        raise ValueError("no source given")
    out = have[0]
    for s in have[1:]:
        out = out.unionByName(s)
    return out.where(~is_blank("question")).distinct()


def table_or_none(spark: SparkSession, name: str) -> DataFrame | None:
    return spark.read.table(name) if spark.catalog.tableExists(name) else None


def parquet_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def preview_items(items: DataFrame, limit: int = 200) -> DataFrame:
    """Six columns of at most ``limit`` items (1 to 2000)."""
    if not 1 <= limit <= PREVIEW_MAX:
        raise ValueError(f"limit must be 1..{PREVIEW_MAX}")
    return items.select(*PREVIEW_COLUMNS).limit(limit)


def append_run(runs: DataFrame, path: str) -> None:
    """Appends rows to the runs index with its fixed schema."""
    fields = [f.strip().split(" ") for f in RUNS_INDEX_SCHEMA.split(",")]
    runs.select(*[F.col(n).cast(t).alias(n) for n, t in fields]).write.mode("append").parquet(path)


def recent_runs(index: DataFrame, limit: int = 50) -> DataFrame:
    """The newest runs first; a top-n, so no full sort. Parameters become a map."""
    return index.orderBy(F.desc("submitted_at"), F.desc("run_id")).limit(limit).withColumn(
        "params", F.from_json("params_json", "map<string,string>")
    )


def append_metrics(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def space_inventory(spaces: DataFrame) -> DataFrame:
    """One row per space: first id present, title with a default, number of tables."""
    have = set(spaces.columns)
    first = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("id", "space_id", "data_room_id") if c in have]
    title = F.nullif(F.col("title"), F.lit(""))
    return spaces.select(
        F.coalesce(*first).alias("space_id"),
        F.coalesce(title, F.lit("(untitled)")).alias("title"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce(F.size("table_identifiers"), F.lit(0)).cast("bigint").alias("n_tables"),
        F.coalesce("warehouse_id", F.lit("")).alias("warehouse_id"),
    )


def count_per_space(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("space_id").agg(F.count("*").alias(name))
