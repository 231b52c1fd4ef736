"""Canonical form of result cells and whole row sets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col_of, strip

# --- fixed values -----------------------------------------------------------
NULL_CELL = "\u0000NULL"
ABS_TOL = "1e-9"
REL_TOL = "0.001"
ROW_CAP = 50
MAX_WIDTH = 7
# ----------------------------------------------------------------------------

# A number may not open with a zero unless "0" or "0." does: 007, 01234, 00.5
# and 0e5 are codes and stay as written.
_PLAIN = r"^[+-]?(?:(?:0|[1-9][0-9]*)(?:\.[0-9]+)?|\.[0-9]+)$"
_CANONICAL = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]*[1-9])?$"
_SCIENTIFIC = r"^[+-]?(?:0\.[0-9]+|[1-9][0-9]*(?:\.[0-9]+)?|\.[0-9]+)[eE][+-]?[0-9]+$"
# Numbers with more places before or behind the point keep an exponent, one for each value: it is of the number, however it is spelled.
_MAX_PLACES = 1_000_000


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _plain_number(s: Column) -> Column:
    """No plus sign, no trailing zeros after the point, a digit before it, no minus zero."""
    cut = F.when(s.contains("."), F.rtrim(F.rtrim(s, F.lit("0")), F.lit("."))).otherwise(s)
    return _bind(
        F.ltrim(cut, F.lit("+")),
        lambda x: F.when(x.isin("", "-", "-0"), "0")
        .when(x.startswith("."), F.concat(F.lit("0"), x))
        .when(x.startswith("-."), F.concat(F.lit("-0"), F.substr(x, F.lit(2))))
        .otherwise(x),
    )


def _expand_exponent(s: Column) -> Column:
    """``1.5E2`` to ``150`` by moving the point; no binary arithmetic, so no digit is lost.

    Equal numbers get equal texts at every size; an exponent of more than 18 digits stays as written.
    """
    lower = F.translate(s, "E", "e")
    mantissa = F.ltrim(F.substring_index(lower, "e", 1), F.lit("+-"))
    whole = F.substring_index(mantissa, ".", 1)
    frac = F.when(mantissa.contains("."), F.substring_index(mantissa, ".", -1)).otherwise("")
    parts = F.struct(
        F.when(s.startswith("-"), "-").otherwise("").alias("sign"),
        F.concat(whole, frac).alias("digits"),
        F.length(whole).alias("point"),
        F.ltrim(F.substring_index(lower, "e", -1), F.lit("+")).try_cast("bigint").alias("shift"),
    )

    def written_out(p: Column) -> Column:
        point = (p["point"] + p["shift"]).cast("int")
        padded = F.concat(
            F.repeat(F.lit("0"), F.greatest(-point, F.lit(0))),
            p["digits"],
            F.repeat(F.lit("0"), F.greatest(point - F.length(p["digits"]), F.lit(0))),
        )
        cut = F.greatest(point, F.lit(0))
        left = F.ltrim(F.substr(padded, F.lit(1), cut), F.lit("0"))
        right = F.substr(padded, cut + 1)
        left = F.when(left == "", "0").otherwise(left)
        return _plain_number(F.when(right == "", F.concat(p["sign"], left)).otherwise(F.concat(p["sign"], left, F.lit("."), right)))

    def move(p: Column) -> Column:
        # the significant digits, and where the point stands before the first of them: both belong to the number, not to its spelling
        some = F.ltrim(p["digits"], F.lit("0"))
        at = p["point"] + p["shift"] - (F.length(p["digits"]) - F.length(some))
        few = F.rtrim(some, F.lit("0"))
        rest = F.when(F.length(few) > 1, F.substr(few, F.lit(2))).otherwise("0")
        return (
            F.when(few == "", "0")
            .when(F.abs(at) <= _MAX_PLACES, written_out(p))
            .when(at > 0, F.concat(p["sign"], few, F.lit("e"), (at - F.length(few)).cast("string")))
            .otherwise(F.concat(p["sign"], F.substr(few, F.lit(1), F.lit(1)), F.lit("."), rest, F.lit("e"), (at - 1).cast("string")))
        )

    return F.coalesce(_bind(parts, move), s)


def _canon_stripped(s: Column) -> Column:
    return (
        F.when(s.isNull(), F.lit(NULL_CELL))
        .when(s.rlike(_CANONICAL) & (s != "-0"), s)
        .when(s.rlike(_PLAIN), _plain_number(s))
        .when(s.rlike(_SCIENTIFIC), _expand_exponent(s))
        .when(s.isin('"NaN"', '"Infinity"', '"-Infinity"'), F.btrim(s, F.lit('"')))
        .otherwise(s)
    )


def canon_cell(c) -> Column:
    """One text cell in canonical form; typed cells are cast to string first."""
    return _bind(strip(col_of(c).cast("string")), _canon_stripped)


def parse_rows(c) -> Column:
    """JSON text to ``array<array<string>>``; blank or broken text is NULL, ``null`` is no rows."""
    c = col_of(c)
    empty = F.array().cast("array<array<string>>")
    return F.when(
        strip(c).isin("null", "{}", "[]", "0", "false", '""'), empty
    ).otherwise(F.from_json(c, "array<array<string>>"))


def canon_rows(rows) -> Column:
    """Every cell of a row set in canonical form; a NULL row is an empty row."""
    blank = F.array().cast("array<string>")
    return F.transform(
        col_of(rows),
        lambda r: F.transform(F.transform(F.coalesce(r, blank), strip), _canon_stripped),
    )
