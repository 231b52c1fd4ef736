"""Statements run in batched plans, their captures kept in a store by statement.

A statement is run once, however many items or replies hold it.  What has to
run is what the store does not hold yet (an anti join); it streams to the
driver in the order of its text, so that statements of one shape are
neighbours.  ``BATCH`` of them become one plan: the union of their captures,
one row each, which the executors write in one job.  A failure while running
ends its batch, which is then run in smaller parts until the failing statement
stands alone; statements of one shape fail together, so other batches do not
pay for it.

Statements that differ in compared values only (``WHERE k = 17``, ``= 18``, …)
are one lateral join of those values with the statement: Spark plans and
compiles it once and reads each table once for all of them.  What fails so, or
cannot be written so, is run statement by statement as above.  Without a
capture (cap 0) a form is first tried in one pass over the rows that it reads,
however many statements it has; that also tells the failing ones (``forms``).

The second run that determinism needs is a job of its own, as Spark would run
what two halves of one plan share only once.  No result passes the driver: it
sees statements and error messages.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from itertools import islice
from queue import SimpleQueue

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.cells import ROW_CAP
from ..functions.text import col_of, is_readonly
from ..session import materialize, scratch_path
from . import forms

BATCH, PARTS, THREADS = 64, 8, 8
#: Statements of one form that share a lateral join, at least and at most; statements that the driver holds at a time, for each thread.
LEAST, SHARED, HELD = 8, 128, 8192
REFUSED = "not run: the statement is not a plain query"

_PARTS = {
    "first": "sql_id string, n_result_rows bigint, expected_rows_json string, fp string",
    "again": "sql_id string, n_again bigint, fp_again string",
    "whole": "sql_id string, n bigint, h0 string, h1 string",
    "whole_again": "sql_id string, n bigint, h0 string, h1 string",
    "failed": "sql_id string, sql_error string",
}


def statement_id(sql) -> Column:
    return F.sha2(F.coalesce(col_of(sql), F.lit("")), 256)


def query_fault(spark: SparkSession, sql: str | None) -> str | None:
    """Why Spark's own parser does not take the statement for a plain query; None if it does.

    A query's tree has no command, no statement that writes and no script in
    it; that holds whatever names, blanks or comments the text is written with.
    """
    jvm = spark._jvm
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql or "")
    except Exception as e:  # a text that is no statement at all
        return str(e)
    logical = "org.apache.spark.sql.catalyst.plans.logical."
    kinds = [jvm.java.lang.Class.forName(logical + k) for k in ("Command", "ParsedStatement", "ScriptTransformation")]
    # commands stand at the top, perhaps below WITH; only a script can lie deeper
    deep = "USING" in (sql or "").upper()
    todo, top = [plan], True
    while todo:
        node = todo.pop()
        if any(k.isInstance(node) for k in kinds):
            return REFUSED
        if deep or top:
            below = node.children()
            todo += [below.apply(i) for i in range(below.size())]
            top = node.getClass().getSimpleName() == "UnresolvedWith"
            if deep:
                below = node.innerChildren()
                todo += [x for x in (below.apply(i) for i in range(below.size())) if jvm.java.lang.Class.forName(logical + "LogicalPlan").isInstance(x)]
    return None


# What a text is made of, as far as it matters here: comments, names and strings are passed over whole.
_TOKEN = re.compile(
    r"--[^\n]*|/\*.*?\*/|`[^`]*`"
    r"|(?<![=\-<>!])(?P<op><=>|<=|>=|<>|!=|==|=|<|>)\s*(?:(?P<int>\d{1,9})(?![\w.])|(?P<text>'[^']*')(?!\s*'))"
    r"|'[^']*'",
    re.S,
)


def form_of(sql: str) -> tuple[str, tuple[str, ...]] | None:
    """The statement with the integers and plain strings that it compares with put as columns of ``asked``, and those values.

    None if it has none, or holds what would let a value be taken for another thing.
    """
    if any(c in sql for c in '\\"$') or "asked" in sql.lower():
        return None
    values: list[str] = []

    def put(m: re.Match) -> str:
        value = m["int"] or m["text"]
        if not value:
            return m[0]
        values.append(value)
        return f"{m['op']} asked.p{len(values) - 1}{'n' if m['int'] else 's'}"

    form = _TOKEN.sub(put, sql)
    return (form, tuple(values)) if values else None


def capture(df: DataFrame, cap: int = ROW_CAP) -> DataFrame:
    """At most cap + 1 rows, so that a longer result can be told from one of exactly ``cap`` rows."""
    return df.limit(cap + 1)


def capture_json(df: DataFrame, cap: int = ROW_CAP) -> DataFrame:
    """The captured rows as one JSON text with its row count; at most cap + 1 rows are gathered."""
    rows = capture(df.toDF(*[f"c{i}" for i in range(len(df.columns))]), cap)
    cells = F.array(*[F.col(f"c{i}").cast("string") for i in range(len(df.columns))])
    rows = rows.select(cells.alias("r")).agg(F.collect_list("r").alias("rows"))
    return rows.select(F.size("rows").cast("bigint").alias("n_result_rows"), F.to_json("rows").alias("expected_rows_json"))


def _named(sql: str, width: int) -> str:
    """The statement as a subquery with columns c0, c1, …, whatever it calls them."""
    return f"(\n{sql.strip().rstrip(';')}\n) AS t({', '.join(f'c{k}' for k in range(width))})"


def _capture_sql(key: str, sql: str, width: int, cap: int) -> str:
    cells = ", ".join(f"CAST(c{k} AS STRING)" for k in range(width))
    return f"SELECT '{key}' AS sql_id, collect_list(r) AS rows FROM (SELECT array({cells}) AS r FROM {_named(sql, width)} LIMIT {cap + 1})"


def _shared_capture_sql(form: str, asked: list[tuple[str, tuple[str, ...]]], width: int, cap: int) -> str:
    """The captures of one form's statements: the values in which they differ joined with the statement that each of them gives."""
    names = {int(p[1:-1]): p for p in re.findall(r"asked\.(p\d+[ns])", form)}
    differ = [k for k in sorted(names) if len({values[k] for _, values in asked}) > 1]
    same = asked[0][1]
    form = re.sub(r"asked\.p(\d+)[ns]", lambda m: m[0] if int(m[1]) in differ else same[int(m[1])], form)
    rows = ", ".join(f"({', '.join([repr(key), *[values[k] for k in differ]])})" for key, values in asked)
    cells = ", ".join(f"CAST(c{k} AS STRING)" for k in range(width))
    return (
        f"SELECT asked.sql_id, collect_list(r) AS rows FROM (VALUES {rows}) AS asked({', '.join(['sql_id', *[names[k] for k in differ]])}) "
        f"LEFT JOIN LATERAL (SELECT array({cells}) AS r FROM {_named(form, width)} LIMIT {cap + 1}) ON TRUE GROUP BY asked.sql_id"
    )


def _captured(rows: DataFrame) -> DataFrame:
    """Captures with a fingerprint of their rows in any order."""
    fp = F.sha2(F.to_json(F.array_sort("rows")), 256).alias("fp")
    return rows.select("sql_id", F.size("rows").cast("bigint").alias("n_result_rows"), F.to_json("rows").alias("expected_rows_json"), fp)


def _fingerprint_sql(key: str, sql: str, width: int) -> str:
    """Row count and two sums of row hashes; null and empty cells differ."""
    cells = ", ".join([f"CAST(c{k} AS STRING)" for k in range(width)] + [f"c{k} IS NULL" for k in range(width)])
    sums = ", ".join(f"CAST(COALESCE(SUM(CAST(xxhash64({salt}, {cells}) AS DECIMAL(20, 0))), 0) AS STRING) AS h{i}" for i, salt in enumerate((1, 2)))
    return f"SELECT '{key}' AS sql_id, COUNT(*) AS n, {sums} FROM {_named(sql, width)}"


class _Store:
    """The parts of a store; threads write into folders of their own, as writers of one folder would clear each other's unfinished files."""

    def __init__(self, spark: SparkSession, path: str, threads: int):
        self.spark, self.path, self.threads, self.slots = spark, path, threads, SimpleQueue()
        for i in range(threads):
            self.slots.put(i)
        for part, schema in _PARTS.items():
            self.write(spark.createDataFrame([], schema), part)

    def write(self, df: DataFrame, part: str) -> None:
        slot = self.slots.get()
        try:
            df.write.mode("append").parquet(f"{self.path}/{part}/{slot}")
        finally:
            self.slots.put(slot)

    def read(self, part: str) -> DataFrame:
        rows = self.spark.read.schema(_PARTS[part]).option("recursiveFileLookup", True).parquet(f"{self.path}/{part}")
        return rows.dropDuplicates(["sql_id"])


class _Job:
    """What a run of statements writes: one SELECT for each, all of them one plan, then the columns of the store's part."""

    def __init__(
        self, select: Callable[[str, str, int], str], finish: Callable[[DataFrame], DataFrame] = lambda df: df, shared: Callable | None = None, one_pass: bool = False
    ):
        self.select, self.finish, self.shared, self.one_pass = select, finish, shared, one_pass

    def together(self, spark: SparkSession, found: list[tuple[str, str, int]]) -> DataFrame:
        """The same of statements of one form."""
        return self.finish(spark.sql(self.shared(*_asked(found), found[0][2])))

    def rows(self, spark: SparkSession, found: list[tuple[str, str, int]]) -> DataFrame:
        # one text is analysed once; frames put together one by one would be analysed at each step
        return self.finish(spark.sql("\nUNION ALL\n".join(self.select(*x) for x in found)))


def _asked(found: list[tuple[str, str, int]]) -> tuple[str, list[tuple[str, tuple[str, ...]]]]:
    """The form of statements that share one, and each one's values."""
    got = [form_of(sql) for _, sql, _ in found]
    return got[0][0], [(x[0], f[1]) for x, f in zip(found, got)]


def _alike(statements: list[tuple[str, str]]) -> bool:
    found = {(f or (None,))[0] for f in (form_of(sql) for _, sql in statements)}
    return len(statements) >= LEAST and len(found) == 1 and None not in found


def _cut(statements: list, most: int) -> list[list]:
    """Parts of about one size, none above ``most``."""
    size = -(-len(statements) // -(-len(statements) // most))
    return [statements[at : at + size] for at in range(0, len(statements), size)]


def _run(store: _Store, statements: list[tuple[str, str]], jobs: dict[str, _Job]) -> list[tuple[str, str]]:
    """Runs a batch, one job for each part of the store it writes; returns what failed with its message."""
    spark = store.spark
    failed: list[tuple[str, str]] = []
    left: list[tuple[str, str, int]] = []
    alike = _alike(statements) and all(job.shared for job in jobs.values())

    def look(some: list[tuple[str, str]]) -> None:
        for i, sql in some:
            fault = query_fault(spark, sql)
            try:
                if fault is None:
                    left.append((i, sql, len(spark.sql(sql).columns)))
                else:
                    failed.append((i, fault))
            except Exception as e:  # the statement is data here; its failure is a result
                failed.append((i, str(e)))

    # statements of one form are queries of one width together, or each is looked at
    look(statements[:1] if alike else statements)
    if alike and left:
        left = [(i, sql, left[0][2]) for i, sql in statements]
    elif alike:
        look(statements[1:])
        alike = False

    def attempt(job: _Job, part: str, some: list[tuple[str, str, int]], together: bool) -> tuple[list, list]:
        """(failures, smaller parts to run)."""
        try:
            store.write(job.together(spark, some) if together else job.rows(spark, some), part)
            return [], []
        except Exception as e:
            if len(some) == 1:
                return [(some[0][0], str(e))], []
            step = -(-len(some) // PARTS)
            if together and step < BATCH:
                step, together = BATCH, False
            return [], [(some[at : at + step], together) for at in range(0, len(some), step)]

    def in_one_pass(job: _Job, part: str) -> bool:
        """Whether all statements of the form, those that fail too, were settled in one pass."""
        try:
            made = forms.together(spark, *_asked(left))
            if made is None:
                return False
            made = materialize(made, "form")
            bad = {r["sql_id"]: r["bad"] for r in made.where("bad > 0").select("sql_id", "bad").toLocalIterator()}
        except Exception:  # what a statement fails with is found when it is run alone
            return False
        if bad:
            # one of them run alone shows that such a row is a failure, and which
            shown, _ = attempt(job, part, [next(x for x in left if x[0] in bad)], False)
            if not shown:
                return False
            like = shown[0][1].split("\n")[0]
            failed.extend(shown + [(i, f"fails in {n} places, as another statement of its form does: {like}") for i, n in bad.items() if i != shown[0][0]])
        store.write(job.finish(made.where("bad = 0").select("sql_id", "rows")), part)
        return True

    for part, job in jobs.items():
        # each run is analysed anew: rand() and the like draw their seeds then
        if alike and left and job.one_pass and in_one_pass(job, part):
            todo = []
        else:
            todo = [(some, alike) for some in _cut(left, SHARED if alike else BATCH)] if left else []
        while todo:
            # the parts of what failed run side by side, as many as the store has writers
            with ThreadPoolExecutor(min(len(todo), store.threads)) as pool:
                ended = list(pool.map(lambda x: attempt(job, part, *x), todo))
            failed += [f for got, _ in ended for f in got]
            todo = [x for _, smaller in ended for x in smaller]
        gone = {i for i, _ in failed}
        left = [x for x in left if x[0] not in gone]
    return failed


def _batches(chunk: list[tuple[str, str]], share: Callable[[str], bool], threads: int, batch: int, most: int = SHARED) -> list[list[tuple[str, str]]]:
    """Statements of one form together, if there are enough, and the others in batches."""
    alike: dict[str, list[tuple[str, str]]] = {}
    rest: list[tuple[str, str]] = []
    for x in chunk:
        f = form_of(x[1]) if share(x[1]) else None
        (alike.setdefault(f[0], []) if f else rest).append(x)
    out = []
    for some in alike.values():
        if len(some) < LEAST:
            rest += some
        else:
            out += _cut(some, most)
    rest.sort(key=lambda x: x[1])
    size = min(batch, -(-len(rest) // threads))
    return out + [rest[at : at + size] for at in range(0, len(rest), size or 1)]


def _each(store: _Store, rows: Iterable, jobs: dict, threads: int, batch: int, share: Callable[[str], bool] = lambda sql: False) -> None:
    """Batches of (sql_id, sql) rows on a few threads; the next ones are read when these are done."""
    stream = iter(rows)
    with ThreadPoolExecutor(threads) as pool:
        while chunk := [(r["sql_id"], r["sql"]) for r in islice(stream, threads * max(batch, HELD))]:
            # a form that is run in one pass is not cut beforehand
            parts = _batches(chunk, share, threads, batch, len(chunk) if all(job.one_pass for job in jobs.values()) else SHARED)
            failed = [f for got in pool.map(lambda p: _run(store, p, jobs), parts) for f in got]
            if failed:
                store.write(store.spark.createDataFrame(failed, _PARTS["failed"]).coalesce(1), "failed")


def run_statements(
    statements: DataFrame, sql: str = "expected_sql", store: str | None = None, cap: int = ROW_CAP, check: bool = True, threads: int = THREADS, batch: int = BATCH
) -> DataFrame:
    """The captures, by sql_id, of the statements in column ``sql``; those that ``store`` (a folder all executors reach) holds are not run again.

    sql_executes, sql_error, n_result_rows, nonempty_result, expected_rows_json
    and sql_deterministic; the last is true unless ``check`` found two runs to
    differ.  A null or empty statement fails like any text that is no query.
    A store belongs to one state of the data; keep one for each.
    """
    spark = statements.sparkSession
    kept = _Store(spark, store or scratch_path(spark, "captures"), threads)
    asked = materialize(statements.select(statement_id(sql).alias("sql_id"), F.coalesce(sql, F.lit("")).alias("sql")).distinct(), "statements")
    known = kept.read("first").select("sql_id")
    if check:
        known = known.join(kept.read("again").select("sql_id"), "sql_id", "left_semi")
    known = known.unionByName(kept.read("failed").select("sql_id"))
    pending = materialize(asked.join(known, "sql_id", "left_anti").withColumn("ro", is_readonly("sql")), "pending")
    refused = pending.where("not ro").select("sql_id", F.lit(REFUSED).alias("sql_error"))
    kept.write(refused, "failed")

    def share(sql: str) -> bool:
        # a lateral join keeps no order of rows; without a capture (cap 0) there is none to keep
        return cap == 0 or "order" not in sql.lower()

    shared = lambda *x: _shared_capture_sql(*x, cap)
    first = _Job(lambda *x: _capture_sql(*x, cap), _captured, shared, cap == 0 and not check)
    again = _Job(lambda *x: _capture_sql(*x, cap), lambda df: _captured(df).select("sql_id", F.col("n_result_rows").alias("n_again"), F.col("fp").alias("fp_again")), shared)
    _each(kept, pending.where("ro").orderBy("sql").toLocalIterator(), {"first": first} | ({"again": again} if check else {}), threads, batch, share)
    if check:
        # captures of both runs complete: they were compared; else the whole results are, by fingerprints
        both = kept.read("first").join(kept.read("again"), "sql_id")
        long = both.where((F.col("n_result_rows") > 0) & (F.greatest("n_result_rows", "n_again") > cap)).select("sql_id")
        long = long.join(kept.read("whole_again").select("sql_id"), "sql_id", "left_anti")
        long = materialize(pending.join(long, "sql_id", "left_semi").select("sql_id", "sql"), "long")
        _each(kept, long.orderBy("sql").toLocalIterator(), {"whole": _Job(_fingerprint_sql), "whole_again": _Job(_fingerprint_sql)}, threads, batch)
    return captures(kept, cap).join(asked.select("sql_id"), "sql_id", "left_semi")


def captures(kept: _Store, cap: int) -> DataFrame:
    """One row for each statement that a store holds."""
    failed = kept.read("failed")
    whole, again = kept.read("whole"), kept.read("whole_again")
    same = whole.join(again.toDF("sql_id", "n2", "g0", "g1"), "sql_id").select("sql_id", F.expr("n = n2 and h0 = g0 and h1 = g1").alias("same"))
    ran = kept.read("first").join(failed.select("sql_id"), "sql_id", "left_anti").join(kept.read("again"), "sql_id", "left").join(same, "sql_id", "left")
    n = F.col("n_result_rows")
    stable = F.coalesce("same", (n == 0) | (F.col("fp") == F.col("fp_again")), F.lit(True))
    columns = ("sql_executes", "sql_error", "n_result_rows", "nonempty_result", "expected_rows_json", "sql_deterministic")
    good = (F.lit(True), F.lit(""), n, n > 0, F.col("expected_rows_json"), stable)
    bad = (F.lit(False), F.col("sql_error"), F.lit(0).cast("bigint"), F.lit(False), F.lit(""), F.lit(True))
    named = lambda df, cells: df.select("sql_id", *[c.alias(k) for k, c in zip(columns, cells)])
    return named(ran, good).unionByName(named(failed, bad))
