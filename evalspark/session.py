"""Session settings and the shared folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, name: str = "evalspark") -> SparkSession:
    """A single-JVM session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    A session on this machine alone without either gets a folder of its own, remembered in the
    session so that later calls agree.  A cluster session without either is
    refused: its executors could not read what the others wrote.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    base = base or spark.conf.get("evalspark.scratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="evalspark-")
        spark.conf.set("evalspark.scratch", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/evalspark/{label}-{uuid.uuid4().hex}"


def materialize(df, label: str):
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage for iterative operators; the files outlive lost executors.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def with_statistics(spark: SparkSession, paths: Mapping[str, str], columns: Mapping[str, list[str]]) -> Iterator[None]:
    """Within it the views that ``columns`` names read the parquet files in ``paths`` with statistics of those columns.

    Without statistics Spark takes the groups of a table to be about as large as
    the table, so that joining the two shuffles the whole table by a few keys;
    with them it sends the groups to the table.  The views, the setting and the
    catalog are afterwards as before: what reads the views has to run within.
    """
    before = {name: spark.table(name) for name in columns}
    cbo = spark.conf.get("spark.sql.cbo.enabled")
    made = []
    try:
        for name, names in columns.items():
            kept = f"evalspark_{name}_{uuid.uuid4().hex}"
            # a table over a path is external: dropping it leaves the files
            spark.catalog.createTable(kept, path=paths[name], source="parquet", schema=before[name].schema)
            made.append(kept)
            spark.sql(f"ANALYZE TABLE {kept} COMPUTE STATISTICS FOR COLUMNS {', '.join(f'`{c}`' for c in names)}")
            spark.table(kept).createOrReplaceTempView(name)
        spark.conf.set("spark.sql.cbo.enabled", "true")
        yield
    finally:
        spark.conf.set("spark.sql.cbo.enabled", cbo)
        for name, df in before.items():
            df.createOrReplaceTempView(name)
        for kept in made:
            spark.sql(f"DROP TABLE {kept}")
