"""Production and cleaning of evaluation items."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import (
    EXEMPT_LITERAL,
    col_of,
    has_relative_time,
    is_blank,
    norm_question,
    numeric_aggregate_identifiers,
    or_default,
    sql_skeleton,
    strip,
    structural_difficulty,
    table_scopes,
)

# --- fixed values -----------------------------------------------------------
FOCUSES = ("aggregation_filter", "ranking_topn", "window_cohort", "ratio_delta_time")
SINGLE_CHUNK_MAX, MAX_CHUNKS, MIN_CHUNKS, CHUNK_SIZE = 12, 4, 2, 10
PROMPT_VARIABLES = ("n", "min_hard", "table", "schema", "space_context", "column_samples")
CATEGORIES = (
    "aggregation", "filter", "time_series", "ranking", "distinct_count",
    "ratio_or_delta", "windowed", "multi_condition", "cohort", "funnel",
)
REQUIRED_CATEGORIES = ("time_series", "ratio_or_delta", "multi_condition", "ranking")
# ----------------------------------------------------------------------------

ITEM_FIELDS = ("question", "expected_sql", "expected_shape", "category", "difficulty", "why_non_trivial")
REPLY_SCHEMA = "struct<questions:array<struct<" + ",".join(f"{f}:string" for f in ITEM_FIELDS) + ">>,_corrupt:string>"


def drop_contaminated(history: DataFrame, prior: DataFrame, question: str = "question", on: tuple[str, ...] = ()) -> DataFrame:
    """History rows whose question is not in the prior set, exactly or once normalised.

    Equal texts have equal normal forms, so one anti join on the normal form
    does both tests; the prior side is made distinct before it is shuffled.
    """
    known = prior.select(*on, norm_question(question).alias("_norm")).distinct()
    return history.withColumn("_norm", norm_question(question)).join(known, [*on, "_norm"], "left_anti").drop("_norm")


def generation_plan(tables: DataFrame, n="n", min_hard="min_hard") -> DataFrame:
    """One row per generation call: how many questions, how many hard, which focus."""
    n, hard = col_of(n).cast("int"), col_of(min_hard).cast("int")
    chunks = F.when(n <= SINGLE_CHUNK_MAX, 1).otherwise(
        F.least(F.lit(MAX_CHUNKS), F.greatest(F.lit(MIN_CHUNKS), F.floor(n / CHUNK_SIZE).cast("int")))
    )
    per = F.ceil(n / chunks).cast("int")
    plan = tables.withColumn("_k", chunks).withColumn("_per", per)
    plan = plan.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    size = F.least(F.col("_per"), n - F.col("chunk") * F.col("_per"))
    share = F.when(F.col("_k") == 1, hard).otherwise(F.greatest(F.lit(1), F.floor(hard / F.col("_k")).cast("int")))
    focus = F.element_at(F.array(*[F.lit(f) for f in FOCUSES]), (F.col("chunk") % len(FOCUSES) + 1).cast("int"))
    return (
        plan.withColumn("chunk_n", size).where((F.col("chunk_n") > 0) | (F.col("_k") == 1))
        .withColumn("chunk_hard", share).withColumn("focus", focus).drop("_k", "_per")
    )


DEFAULT_TEMPLATE = (
    "Write {{n}} questions with SQL answers for {{table}}, at least {{min_hard}} of them hard.\n"
    "Schema:\n{{schema}}\nObserved values:\n{{column_samples}}\nContext:\n{{space_context}}\n"
    "Rules:\n  1. Use observed values only.\n  2. Use literal dates only.\n"
    "Return ONLY a JSON object with the key `questions`."
)


def check_template(template: str) -> str:
    """The template itself, once it names every variable."""
    missing = [v for v in PROMPT_VARIABLES if "{{" + v + "}}" not in template]
    if missing:
        raise ValueError(f"template lacks variables: {missing}")
    return template


def add_rule(template: str, rule: str) -> str:
    """Another numbered rule before the reply instruction, numbered after the last one."""
    if not rule.strip():
        return template
    import re

    last = max((int(m) for m in re.findall(r"(?m)^\s+(\d+)\.\s", template)), default=0)
    return template.replace("Return ONLY a JSON object", f"  {last + 1}. {rule.strip()}\nReturn ONLY a JSON object")


def prompts(plan: DataFrame, profiles: DataFrame, on: list[str], template: str = DEFAULT_TEMPLATE, rule: str = "") -> DataFrame:
    """One prompt text per planned call; ``profiles`` brings table, schema, samples and context.

    Values are placed by splitting the template at its variables, so a value
    that itself looks like a variable is left alone.
    """
    import re

    text = add_rule(check_template(template), rule)
    joined = plan.join(profiles, on)
    source = {
        "n": F.col("chunk_n").cast("string"),
        "min_hard": F.col("chunk_hard").cast("string"),
        "table": F.col("table"),
        "schema": F.coalesce("schema_text", F.lit("")),
        "space_context": F.concat(
            F.coalesce("context", F.lit("")), F.lit("\n\nSHAPE FOCUS for this batch: "), F.col("focus")
        ),
        "column_samples": F.coalesce("column_samples", F.lit("  (no low-cardinality columns)")),
    }
    pieces = re.split(r"\{\{(" + "|".join(PROMPT_VARIABLES) + r")\}\}", text)
    return joined.withColumn("prompt", F.concat(*[source[p] if i % 2 else F.lit(p) for i, p in enumerate(pieces)]))


def parse_replies(replies: DataFrame, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """Items of the parseable replies in order, and the replies that failed with the reason."""
    parsed = replies.withColumn("_p", F.from_json(content, REPLY_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt"}))
    failed = F.col("_p").isNull() | F.col("_p._corrupt").isNotNull()
    meta = [c for c in replies.columns if c != content]
    good = (
        parsed.where(~failed)
        .select(*meta, F.posexplode_outer("_p.questions").alias("item_idx", "_q"))
        .where(F.col("item_idx").isNotNull())
        .select(*meta, "item_idx", *[F.col(f"_q.{f}").alias(f) for f in ITEM_FIELDS])
    )
    reason = F.when(F.col(content).isNull(), "reply is empty").otherwise("reply is not the expected JSON")
    return good, parsed.where(failed).select(*meta, reason.alias("error"))


def normalise_items(items: DataFrame) -> DataFrame:
    """Items with both texts present, trimmed, defaults filled in."""
    defaults = {"expected_shape": "", "category": "uncategorized", "difficulty": "medium", "why_non_trivial": "", "table": "", "shape_focus": ""}
    out = items.where(~is_blank(F.col("question").cast("string")) & ~is_blank(F.col("expected_sql").cast("string")))
    out = out.withColumn("question", strip("question")).withColumn("expected_sql", strip("expected_sql"))
    for c, d in defaults.items():
        out = out.withColumn(c, or_default(c, d) if c in items.columns else F.lit(d))
    return out


def drop_relative_time(items: DataFrame) -> DataFrame:
    return items.where(~has_relative_time("question", "expected_sql"))


def drop_counts(items: DataFrame, by: list[str] | None = None, catalog: DataFrame | None = None) -> DataFrame:
    """How many items each cleaning rule drops, in their order.

    With a catalog also those with a numeric aggregate of a text column and,
    of what is left then, the later ones of each SQL skeleton.
    """
    bad = is_blank(F.col("question").cast("string")) | is_blank(F.col("expected_sql").cast("string"))
    rel = ~bad & has_relative_time("question", "expected_sql")
    counts = [F.count("*").alias("n_items"), F.count_if("_bad").alias("n_malformed"), F.count_if("_rel").alias("n_relative")]
    marked = items.withColumn("_bad", bad).withColumn("_rel", rel)
    if catalog is not None:
        marked = typed_aggregate_violations(marked, catalog)
        left = ~F.col("_bad") & ~F.col("_rel") & (F.size("bad_columns") == 0)
        marked = marked.withColumn("_skeleton", F.when(left, sql_skeleton("expected_sql")))
        typed = ~F.col("_bad") & ~F.col("_rel") & (F.size("bad_columns") > 0)
        counts += [F.count_if(typed).alias("n_typed"), (F.count("_skeleton") - F.count_distinct("_skeleton")).alias("n_duplicate")]
    return marked.groupBy(*(by or [])).agg(*counts)


def table_types(catalog: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``(by…, _table, _text, _other)``: lower-case names of the text and boolean columns of each table, and of its others."""
    kind = F.lower("type")
    text = kind.contains("string") | kind.contains("boolean")
    name = F.lower("column")
    return catalog.groupBy(*(by or []), F.element_at(F.split(F.lower("table"), r"\."), -1).alias("_table")).agg(
        F.collect_set(F.when(text, name)).alias("_text"), F.collect_set(F.when(~text, name)).alias("_other")
    )


def typed_aggregate_violations(items: DataFrame, catalog: DataFrame, by: list[str] | None = None, sql: str = "expected_sql") -> DataFrame:
    """Adds ``bad_columns``: text or boolean columns inside a numeric aggregate of the SQL.

    A name is looked up in the tables that its statement names, a qualified one
    in the table of that name or alias alone; one that a table of the statement
    has as a number is no text.  Each distinct statement meets the types of its
    own tables by an equality join, so no statement carries the whole catalog.
    """
    by = list(by or [])
    key = F.sha2(F.coalesce(F.col(sql), F.lit("")), 256).alias("_sid")
    statements = items.select(*by, key, F.col(sql).alias("_sql")).distinct()
    scopes = statements.select(*by, "_sid", numeric_aggregate_identifiers("_sql").alias("_names"), F.explode(table_scopes("_sql")).alias("_s"))
    scopes = scopes.where(F.size("_names") > 0).withColumn("_table", F.col("_s.table"))
    met = scopes.join(table_types(catalog, by), [*by, "_table"])
    # as many entries as the statement has tables
    met = met.groupBy(*by, "_sid").agg(F.first("_names").alias("_names"), F.collect_list(F.struct("_table", "_s.alias", "_text", "_other")).alias("_scope"))

    def bad(name: Column) -> Column:
        parts = F.split(name, r"\.")
        column, owner = F.element_at(parts, -1), F.when(F.size(parts) > 1, F.element_at(parts, -2))
        own = F.filter("_scope", lambda s: owner.isNull() | (owner == s["alias"]) | (owner == s["_table"]))
        has = lambda f: F.exists(own, lambda s: F.array_contains(s[f], column))
        return has("_text") & ~has("_other")

    last = F.transform(F.filter("_names", bad), lambda n: F.element_at(F.split(n, r"\."), -1))
    found = met.select(*by, "_sid", F.array_sort(F.array_distinct(last)).alias("bad_columns"))
    marked = items.withColumn("_sid", key).join(found, [*by, "_sid"], "left").drop("_sid")
    return marked.select(*items.columns, F.coalesce("bad_columns", F.array().cast("array<string>")).alias("bad_columns"))


def drop_typed_violations(items: DataFrame, catalog: DataFrame, by: list[str] | None = None) -> DataFrame:
    return typed_aggregate_violations(items, catalog, by).where(F.size("bad_columns") == 0).drop("bad_columns")


def dedup_skeleton(items: DataFrame, by: list[str] | None = None, pos: str = "pos", sql: str = "expected_sql") -> DataFrame:
    """The first item per SQL skeleton in generation order.

    ``min_by`` keeps one candidate per skeleton and task, so a skeleton shared
    by a third of all items still shuffles one row per task.
    """
    by = list(by or [])
    key = [*by, "_skeleton"]
    rest = [c for c in items.columns if c not in by]
    first = (
        items.withColumn("_skeleton", sql_skeleton(sql))
        .groupBy(*key)
        .agg(F.min_by(F.struct(*rest), F.struct(pos, "question")).alias("_first"))
    )
    return first.select(*by, "_first.*").select(*items.columns)


def item_id(by: list[str], pos: str = "pos", question: str = "question") -> Column:
    """A stable id; a random one would change whenever a lost partition is recomputed."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in (*by, pos, question)]
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def structural_labels(items: DataFrame, sql: str = "expected_sql") -> DataFrame:
    s = structural_difficulty(sql)
    return items.withColumn("difficulty_structural", s).withColumn(
        "difficulty_label_matches", F.lower(F.coalesce("difficulty", F.lit(""))) == s
    )


# One template per category.  Literals come from profiled values only.
TEMPLATES = (
    ("aggregation", "medium", "How many rows of %s are there per %s?",
     "SELECT %2$s, COUNT(*) AS n FROM %1$s GROUP BY %2$s"),
    ("filter", "easy", "How many rows of %s have %s equal to %s?",
     "SELECT COUNT(*) AS n FROM %1$s WHERE %2$s = '%3$s'"),
    ("ranking", "hard", "Which 3 values of %2$s are most frequent in %1$s, leaving out %3$s?",
     "SELECT %2$s, COUNT(*) AS n FROM %1$s WHERE %2$s <> '%3$s' GROUP BY %2$s HAVING COUNT(*) > 1 ORDER BY n DESC, %2$s LIMIT 3"),
    ("ratio_or_delta", "hard", "What percentage of the rows of %1$s has %2$s equal to %3$s?",
     "SELECT 100.0 * SUM(CASE WHEN %2$s = '%3$s' THEN 1 ELSE 0 END) / COUNT(*) AS pct FROM %1$s"),
    ("distinct_count", "easy", "How many different values of %2$s other than %3$s does %1$s hold?",
     "SELECT COUNT(DISTINCT %2$s) AS n FROM %1$s WHERE %2$s <> '%3$s'"),
    ("windowed", "hard", "How do the values of %2$s in %1$s rank by row count, with %3$s left out?",
     "SELECT %2$s, RANK() OVER (ORDER BY COUNT(*) DESC) AS rk FROM %1$s WHERE %2$s <> '%3$s' GROUP BY %2$s"),
)


def templated_items(values: DataFrame) -> DataFrame:
    """Items from profiled ``(table, column, value)`` rows; every literal is an observed value.

    The templates ride along as a literal array, so each profile row expands
    in place without a join.
    """
    quoted = F.replace(F.col("value"), F.lit("'"), F.lit("''"))
    built = F.array(
        *[
            F.struct(
                F.lit(cat).alias("category"),
                F.lit(diff).alias("difficulty"),
                F.format_string(q, "table", "column", "value").alias("question"),
                F.format_string(s, F.col("table"), F.col("column"), quoted).alias("expected_sql"),
            )
            for cat, diff, q, s in TEMPLATES
        ]
    )
    return values.select("table", "column", "value", F.inline(built))


# A value with one of the table's next column, with the next value of its own column, and with a date range.
PAIR_TEMPLATE = (
    "multi_condition", "medium", "How many rows of %1$s have %2$s equal to %3$s and %4$s equal to %5$s?",
    "SELECT %2$s, COUNT(*) AS n FROM %1$s WHERE %2$s = '%3$s' AND %4$s = '%5$s' GROUP BY %2$s")
REST_TEMPLATE = (
    "multi_condition", "medium", "How many rows per %2$s does %1$s have besides those with %3$s and %4$s?",
    "SELECT %2$s, COUNT(*) AS n FROM %1$s WHERE %2$s <> '%3$s' AND %2$s <> '%4$s' GROUP BY %2$s")
SERIES_TEMPLATE = (
    "time_series", "medium", "How many rows does %1$s have per month of %2$s from %3$s to %4$s?",
    "SELECT date_trunc('month', %2$s) AS month, COUNT(*) AS n FROM %1$s WHERE %2$s BETWEEN '%3$s' AND '%4$s' GROUP BY date_trunc('month', %2$s)")
COHORT_TEMPLATE = (
    "cohort", "hard", "Group the values of %2$s in %1$s by the month of %3$s of their first row from %4$s to %5$s: how many values and rows has each group per month?",
    "WITH c AS (SELECT %2$s AS k, MIN(%3$s) AS start FROM %1$s WHERE %3$s BETWEEN '%4$s' AND '%5$s' GROUP BY %2$s) "
    "SELECT date_trunc('month', start) AS cohort, date_trunc('month', %3$s) AS month, COUNT(DISTINCT k) AS n_values, COUNT(*) AS n "
    "FROM %1$s JOIN c ON %2$s = k WHERE %3$s BETWEEN '%4$s' AND '%5$s' GROUP BY date_trunc('month', start), date_trunc('month', %3$s)")
FUNNEL_TEMPLATE = (
    "funnel", "hard", "Of the rows of %1$s with %3$s from %4$s to %5$s, how many have %2$s equal to %6$s, and how many of these come after the first row with %7$s?",
    "WITH f AS (SELECT MIN(%3$s) AS start FROM %1$s WHERE %2$s = '%7$s') "
    "SELECT COUNT(*) AS step_1, COUNT(CASE WHEN %2$s = '%6$s' THEN 1 END) AS step_2, COUNT(CASE WHEN %2$s = '%6$s' AND %3$s > start THEN 1 END) AS step_3 "
    "FROM %1$s CROSS JOIN f WHERE %3$s BETWEEN '%4$s' AND '%5$s'")


def _filled(rows: DataFrame, template: tuple[str, str, str, str], *args: str) -> DataFrame:
    """One item of the template per row, with these columns in its places."""
    category, difficulty, question, sql = template
    quoted = [F.replace(F.col(a), F.lit("'"), F.lit("''")) for a in args]
    return rows.select(
        "table", F.lit(category).alias("category"), F.lit(difficulty).alias("difficulty"),
        F.format_string(question, *args).alias("question"), F.format_string(sql, *quoted).alias("expected_sql"),
    )


def profiled_items(values: DataFrame, ranges: DataFrame) -> DataFrame:
    """Items of all ten categories from ``(table, column, value)`` and ``(table, column, lo, hi)`` rows, each once.

    A value is combined with the smallest value of the table's next column (the
    last column's next is the first) and with the next value of its own column,
    so the items grow with the profile, not with its square.  Items that need a
    second value or a date range are left out where there is none.
    """
    own = Window.partitionBy("table", "column").orderBy("value")
    turn = Window.partitionBy("table").orderBy("column")
    columns = values.groupBy("table", "column").agg(F.min("value").alias("_least"))
    entry = F.struct(F.col("column").alias("column"), F.col("_least").alias("value"))
    nexts = columns.select("table", "column", F.coalesce(F.lead(entry).over(turn), F.first(entry).over(turn)).alias("_n"))
    paired = values.withColumn("value_2", F.coalesce(F.lead("value").over(own), F.first("value").over(own))).join(nexts, ["table", "column"])
    paired = paired.select("*", F.col("_n.column").alias("column_2"), F.col("_n.value").alias("least_2"))
    alone, other = F.col("column") == F.col("column_2"), F.col("value") != F.col("value_2")
    dated = ranges.select("table", F.col("column").alias("day"), "lo", "hi")
    parts = [
        templated_items(values).select("table", "category", "difficulty", "question", "expected_sql"),
        _filled(paired.where(~alone), PAIR_TEMPLATE, "table", "column", "value", "column_2", "least_2"),
        _filled(paired.where(alone & other), REST_TEMPLATE, "table", "column", "value", "value_2"),
        _filled(dated, SERIES_TEMPLATE, "table", "day", "lo", "hi"),
        _filled(columns.join(dated, "table"), COHORT_TEMPLATE, "table", "column", "day", "lo", "hi"),
        _filled(paired.where(other).join(dated, "table"), FUNNEL_TEMPLATE, "table", "column", "day", "lo", "hi", "value", "value_2"),
    ]
    return reduce(DataFrame.unionByName, parts).distinct()


def distribution_check(items: DataFrame, by: list[str], min_hard: int = 5) -> DataFrame:
    """Does each batch keep to the required mix of difficulties and categories?"""
    d, c = F.lower("difficulty"), F.lower("category")
    s = items.groupBy(*by).agg(
        F.count_if(d == "easy").alias("n_easy"),
        F.count_if(d == "hard").alias("n_hard"),
        *[F.count_if(c == k).alias(f"n_{k}") for k in REQUIRED_CATEGORIES],
    )
    ok = (F.col("n_easy") <= 1) & (F.col("n_hard") >= min_hard)
    for k in REQUIRED_CATEGORIES:
        ok = ok & (F.col(f"n_{k}") >= 1)
    return s.withColumn("passed", ok)
