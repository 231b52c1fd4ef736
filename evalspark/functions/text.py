"""Column expressions over question text and SQL text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# --- fixed values -----------------------------------------------------------
HARD_TOKENS = (
    " WITH ", " OVER (", " OVER(", "LAG(", "LEAD(", "RANK(", "DENSE_RANK(", "NTILE(",
    "ROW_NUMBER(", "PERCENTILE", "APPROX_COUNT_DISTINCT", " EXISTS", " HAVING ",
    "CASE WHEN", " INTERSECT ", " QUALIFY ",
)
REPLY_HARD_TOKENS = (
    " WITH ", " OVER (", "LAG(", "LEAD(", "RANK(", "DENSE_RANK(", "NTILE(",
    "ROW_NUMBER(", "PERCENTILE_APPROX", "APPROX_COUNT_DISTINCT", "EXISTS",
    "HAVING ", "CASE WHEN",
)
RELATIVE_QUESTION = (
    r"(?i)\bthis (month|week|year|quarter)\b|\blast \d+ (day|week|month)s?\b|\bnext \d+"
)
RELATIVE_SQL = r"(?i)current_date|current_timestamp|\bnow\s*\(|\bgetdate\s*\("
EXEMPT_LITERAL = r"^\d{4}-\d{2}-\d{2}$|^\d+(\.\d+)?$"
EXTRACTED_STATEMENT = r"(?is)\b((?:WITH|SELECT)\b.*)"
QUOTED = r"'([^']+)'"
MEDIUM_TOKENS = (" JOIN ", "GROUP BY")
NUMERIC_AGGREGATES = (
    "SUM", "AVG", "STDDEV", "VARIANCE", "STDDEV_POP", "STDDEV_SAMP", "VAR_POP", "VAR_SAMP",
)
# ----------------------------------------------------------------------------

_BLANK = r"[\s\x1c-\x1f]"
# every character that Unicode, or the C locale, counts as blank
_BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Trim every Unicode blank on both ends."""
    return F.btrim(col_of(c), F.lit(_BLANKS))


def is_blank(c) -> Column:
    """True for NULL and for text of blanks only."""
    return F.coalesce(strip(c) == "", F.lit(True))


def or_default(c, default: str) -> Column:
    """The text, or ``default`` where it is NULL or empty."""
    c = col_of(c).cast("string")
    return F.when(c.isNull() | (c == ""), F.lit(default)).otherwise(c)


def norm_question(c) -> Column:
    """Lower case, single blanks, no trailing ``?``, ``.``, ``!`` or blank."""
    squeezed = F.regexp_replace(F.lower(strip(F.coalesce(col_of(c), F.lit("")))), rf"(?U){_BLANK}+", " ")
    return F.regexp_replace(squeezed, r"[?.! ]+$", "")


def has_relative_time(question, sql) -> Column:
    q = F.coalesce(col_of(question).cast("string"), F.lit(""))
    s = F.coalesce(col_of(sql).cast("string"), F.lit(""))
    return q.rlike(RELATIVE_QUESTION) | s.rlike(RELATIVE_SQL)


# literals, quoted names and comments; possessive, so that no length of text is too long
_LITERAL = r"'[^']*+(?:''[^']*+)*+'"
_NO_CODE = rf"{_LITERAL}|`[^`]*+`|--[^\n]*+|/\*[^*]*+(?:\*(?!/)[^*]*+)*+\*/"
_WRITES = (
    r"\b(?:INSERT\s+(?:INTO|OVERWRITE)|MERGE\s+INTO|DELETE\s+FROM|UPDATE\s+\S+\s+SET|"
    r"(?:CREATE|DROP|ALTER|TRUNCATE|REPLACE)\s+(?:OR\b|TEMP|GLOBAL|EXTERNAL|TABLE|VIEW|DATABASE|SCHEMA|FUNCTION|CATALOG))\b"
)


def is_readonly(sql) -> Column:
    """A query: SELECT or WITH first, and no writing clause anywhere in the code.

    ``WITH ... INSERT`` starts like a query and is a command, so the start alone
    proves nothing.  Literals and comments are no code.
    """
    code = F.upper(strip(F.regexp_replace(F.coalesce(col_of(sql), F.lit("")), _NO_CODE, " ")))
    return code.rlike("^(SELECT|WITH)") & ~code.rlike(_WRITES)


def extract_sql(raw) -> Column:
    """The first statement inside a model reply: no fences, no prose around it."""
    bare = strip(F.regexp_replace(F.coalesce(col_of(raw), F.lit("")), r"```(sql)?", ""))
    from_keyword = F.regexp_extract(bare, EXTRACTED_STATEMENT, 1)
    no_prose = F.split(from_keyword, r"\n\s*\n(?=[A-Z][a-z])", 2)[0]
    return F.when(from_keyword == "", bare).otherwise(strip(F.split(no_prose, ";", 2)[0]))


def structural_difficulty(sql) -> Column:
    """easy, medium or hard, from tokens of the SQL text alone."""
    s = F.concat(F.lit(" "), F.upper(F.coalesce(col_of(sql), F.lit(""))), F.lit(" "))
    hard = reduce(lambda a, b: a | b, [s.contains(t) for t in HARD_TOKENS])
    medium = reduce(lambda a, b: a | b, [s.contains(t) for t in MEDIUM_TOKENS]) | (s.contains("ORDER BY") & s.contains(" LIMIT "))
    return F.when(hard, "hard").when(medium, "medium").otherwise("easy")


def has_reply_hard_token(sql) -> Column:
    s = F.upper(F.coalesce(col_of(sql), F.lit("")))
    return reduce(lambda a, b: a | b, [s.contains(t) for t in REPLY_HARD_TOKENS])


def mask_literals(sql) -> Column:
    """String literals become ``'?'`` so that later patterns see code only."""
    return F.regexp_replace(F.coalesce(col_of(sql), F.lit("")), _LITERAL, "'?'")


def sql_skeleton(sql) -> Column:
    """Duplicate key of a statement: literals masked, names kept, case and blanks folded."""
    s = F.regexp_replace(mask_literals(sql), r"(?<![A-Za-z0-9_.])(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?(?![A-Za-z0-9_])", "0")
    s = F.regexp_replace(F.lower(s), r"\s+", " ")
    s = F.regexp_replace(s, r"\s*([(),=<>+*/;-])\s*", "$1")
    return F.regexp_replace(s, r"^[\s;]+|[\s;]+$", "")


def sql_identifiers(sql) -> Column:
    """Distinct lower-case words outside string literals that can name a column."""
    bare = F.regexp_replace(mask_literals(sql), r"'\?'", " ")
    return F.array_distinct(F.regexp_extract_all(F.lower(bare), F.lit(r"([a-z_][a-z0-9_]*)"), F.lit(1)))


_PIECES = rf"(\b(?:{'|'.join(NUMERIC_AGGREGATES)})\s*+\(|[()]|\b[A-Z_][A-Z0-9_]*+(?:\.[A-Z_][A-Z0-9_]*+)*+)"
# words that end a table's name and alias in FROM and JOIN
_NO_ALIAS = "(?!(?:AS|ON|USING|WHERE|GROUP|ORDER|HAVING|LIMIT|UNION|EXCEPT|INTERSECT|MINUS|JOIN|INNER|LEFT|RIGHT|FULL|CROSS|SEMI|ANTI|NATURAL|LATERAL|PIVOT|UNPIVOT|TABLESAMPLE|WINDOW|QUALIFY|SELECT)\\b)"
_TABLE = rf"[A-Z_][A-Z0-9_]*+(?:\.[A-Z_][A-Z0-9_]*+)*+(?:\s++(?:AS\s++)?{_NO_ALIAS}[A-Z_][A-Z0-9_]*+)?"
_TABLES = rf"\b(?:FROM|JOIN)\s++({_TABLE}(?:\s*+,\s*+{_TABLE})*+)"


def table_scopes(sql) -> Column:
    """The tables that the statement names after FROM and JOIN, subqueries' too: structs (table, alias) in lower case, the table without what qualifies it.

    A table without an alias goes by its name.
    """
    bare = F.regexp_replace(F.regexp_replace(mask_literals(sql), r"--[^\n]*+|/\*[^*]*+(?:\*(?!/)[^*]*+)*+\*/", " "), r"[`\"]", "")
    lists = F.regexp_extract_all(F.upper(bare), F.lit(_TABLES), F.lit(1))
    words = F.transform(F.flatten(F.transform(lists, lambda x: F.split(x, r"\s*,\s*"))), lambda x: F.split(F.lower(F.btrim(x)), r"\s+"))

    def scope(w: Column) -> Column:
        name = F.element_at(F.split(F.get(w, F.lit(0)), r"\."), -1)
        return F.struct(name.alias("table"), F.when(F.size(w) > 1, F.element_at(w, -1)).otherwise(name).alias("alias"))

    return F.array_distinct(F.transform(words, scope))


def numeric_aggregate_identifiers(sql) -> Column:
    """Distinct lower-case names inside the arguments of numeric aggregates, with what qualifies them, nested as deep as they may be.

    One pass over brackets and words: words count from the outermost aggregate's
    bracket to the one that closes it; an argument that is never closed is none.
    """
    bare = F.upper(F.regexp_replace(mask_literals(sql), r"'\?'", " "))
    pieces = F.regexp_extract_all(bare, F.lit(_PIECES), F.lit(1))
    # the fold keeps places only, and one entry for each outermost aggregate
    spans = F.array().cast("array<struct<lo:int,n:int>>")
    start = F.struct(*[F.lit(0).alias(f) for f in ("depth", "since", "at", "lo")], spans.alias("found"))

    def state(a, **new) -> Column:
        return F.struct(*[(new[f] if f in new else a[f]).alias(f) for f in ("depth", "since", "at", "lo", "found")])

    def step(a: Column, t: Column) -> Column:
        deeper, at = a["depth"] + 1, a["at"] + 1
        closes = (a["since"] > 0) & (a["since"] == a["depth"])
        span = F.struct(a["lo"].alias("lo"), (at - a["lo"]).alias("n"))
        return (
            F.when(t == "(", state(a, at=at, depth=deeper))
            .when((t == ")") & closes, state(a, at=at, depth=a["depth"] - 1, since=F.lit(0), found=F.array_append(a["found"], span)))
            .when(t == ")", state(a, at=at, depth=F.greatest(a["depth"] - 1, F.lit(0))))
            .when(t.endswith("(") & (a["since"] == 0), state(a, at=at, depth=deeper, since=deeper, lo=at + 1))
            .when(t.endswith("("), state(a, at=at, depth=deeper))
            .otherwise(state(a, at=at))
        )

    found = F.aggregate(pieces, start, step, lambda a: a["found"])
    inside = F.flatten(F.transform(found, lambda s: F.slice(pieces, s["lo"], s["n"])))
    names = F.filter(inside, lambda t: ~t.isin("(", ")"))
    return F.array_distinct(F.transform(names, lambda t: F.lower(F.regexp_replace(t, r"\s*+\($", ""))))


def quoted_literals(c) -> Column:
    """Distinct non-empty texts between single quotes."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(col_of(c), F.lit("")), F.lit(QUOTED), F.lit(1)))


def sample_literals(c) -> Column:
    """Distinct non-empty texts between single or double quotes, line by line."""
    text = F.coalesce(col_of(c), F.lit(""))
    one = F.regexp_extract_all(text, F.lit(r"'([^'\n]+)'"), F.lit(1))
    two = F.regexp_extract_all(text, F.lit(r'"([^"\n]+)"'), F.lit(1))
    return F.array_union(one, two)


def invented_literals(sql, allowed, ignore: tuple[str, ...] = ()) -> Column:
    """Sorted literals of the SQL that are neither allowed, a date nor a number."""
    left = F.array_except(quoted_literals(sql), allowed)
    keep = F.filter(left, lambda v: ~v.rlike(EXEMPT_LITERAL) & ~v.isin(*ignore) if ignore else ~v.rlike(EXEMPT_LITERAL))
    return F.array_sort(keep)
