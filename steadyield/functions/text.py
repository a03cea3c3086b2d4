"""Normalising codes, numbers, dates, ratios and descriptions of corporate actions.

What cannot be read is null; callers decide whether that is an error.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """What use makes of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def nfkc(text: str | Column) -> Column:
    """Compatibility form, which SQL has no function for."""

    @F.arrow_udf(StringType())
    def fold(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else unicodedata.normalize("NFKC", v) for v in values.to_pylist()], pa.string())

    return fold(text)


def folded(text: str | Column) -> Column:
    """Compatibility form; text of ASCII alone is its own and is not sent through Python."""
    raw = F.col(text) if isinstance(text, str) else text
    return F.coalesce(nfkc(F.when(raw.rlike(r"[^\x00-\x7F]"), raw)), raw)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def compact(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", "")


def narrow(text: Column) -> Column:
    """Full-width digits, letters and the commonest marks in their ASCII form."""
    wide = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F)) + "　"
    return F.translate(text, wide, "".join(chr(c) for c in range(0x21, 0x7F)) + " ")


def _narrowed(text: Column) -> Column:
    """narrow for a text that has yet to be worked out; one of ASCII alone is its own."""
    return let(text, lambda t: F.when(F.length(t) == F.octet_length(t), t).otherwise(narrow(t)))


def security_code(value: str | Column) -> Column:
    """Four characters; a fifth that is 0 and a numeric reader's .0 fall away."""
    text = F.upper(F.trim(_narrowed(F.col(value) if isinstance(value, str) else value)))
    short = lambda t: F.regexp_replace(F.regexp_replace(t, r"\.0$", ""), r"^(.{4})0$", "$1")
    # most texts fail the first pattern and are not worked on further
    return let(text, lambda t: F.when(t.rlike(r"^[0-9A-Z]{4}0?(\.0)?$"), let(short(t), lambda u: F.when(u.rlike("^[0-9A-Z]{4}$"), u))))


def number(value: str | Column) -> Column:
    """Plain, grouped, bracketed or marked numbers; a dash means none."""
    raw = F.col(value) if isinstance(value, str) else value
    text = F.regexp_replace(narrow(raw), r"[,\s円株%倍]", "")
    text = F.regexp_replace(text, "^[△▲−‐-]", "-")
    text = F.regexp_replace(text, r"^\((.*)\)$", "-$1")
    marked = F.regexp_extract(text, r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$", 0).try_cast("double")
    # most are plain and need none of the above
    return F.when(raw.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), raw.try_cast("double")).otherwise(marked)


def found_number(value: Column, quoted: bool = False) -> Column:
    """The first number in a text. Triangles and wide signs are signs, grouping and units don't count; a dash alone means none.

    A number in brackets is negative, unless it is quoted: quoted ones have no
    exponents, may have blanks within and a mark of the exchange in front.
    """
    text = F.translate(F.translate(value, "０１２３４５６７８９＋▲△−－", "0123456789+----"), ",円株%", "")
    if quoted:
        text = F.regexp_replace(F.regexp_replace(text, r"\s+", ""), "^(-?)[カウ]", "$1")
    number = F.regexp_extract(text, r"[-+]?[0-9]+(?:\.[0-9]+)?" + ("" if quoted else r"(?:[Ee][-+]?[0-9]+)?"), 0).try_cast("double")
    found = number if quoted else F.when(text.startswith("(") & text.endswith(")"), -F.abs(number)).otherwise(number)
    # most are plain and need none of the above
    return F.when(value.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), value.try_cast("double")).otherwise(found)


def whole_number(value: str | Column) -> Column:
    """A non-negative whole number, else null."""
    n = number(value)
    return F.when((n >= 0) & (n == F.floor(n)), n.cast("long"))


def day(value: str | Column) -> Column:
    """Dates written with dots, dashes or slashes."""
    return let(_narrowed(F.trim(value)), lambda t: F.when(t.rlike(r"^\d{4}[-./]\d{1,2}[-./]\d{1,2}$"), F.try_to_date(F.regexp_replace(t, "[./]", "-"), "y-M-d")))


RATIO = r"(\d+(?:\.\d+)?)\s*[:：対]\s*(\d+(?:\.\d+)?)"


def ratio_factor(text: Column, added: bool = False) -> Column:
    """before / after of a ratio "before:after", half up to ten places; with added the second number comes on top of the first."""
    return let(_ratio_in(narrow(text)), lambda r: _divided(r, added))


def _ratio_in(plain: Column) -> Column:
    """The two numbers of a ratio in narrow text."""
    return F.struct(*(F.regexp_extract(plain, RATIO, k).try_cast("decimal(20,10)").alias(name) for k, name in ((1, "before"), (2, "after"))))


def _divided(r: Column, added: bool) -> Column:
    before, after = r["before"], r["after"]
    below = before + after if added else after
    return F.when((before > 0) & (after > 0), F.round((before / below).cast("decimal(38,18)"), 10).cast("decimal(20,10)"))


def action(description: str | Column) -> Column:
    """Struct of factor, kind and whether the row is ignored or cannot be read.

    Kind 1 multiplies shares, 2 consolidates them, 3 is not adjusted for. The
    order of the tests matters: later words occur within earlier ones.
    """
    text = collapsed(narrow(F.col(description) if isinstance(description, str) else description))
    return let(text, lambda t: let(F.struct(t.alias("text"), _ratio_in(t).alias("ratio")), lambda x: _action_of(x["text"], x["ratio"])))


def _action_of(text: Column, ratio: Column) -> Column:
    has = lambda *words: reduce(lambda a, b: a | b, [text.contains(w) for w in words])
    factor, topped = _divided(ratio, False), _divided(ratio, True)

    def made(value: Column | None, kind: str | None) -> Column:
        return F.struct((F.lit(None).cast("decimal(20,10)") if value is None else value.cast("decimal(20,10)")).alias("factor"), F.lit(kind).cast("string").alias("kind"), (F.lit(False) if value is None else value.isNull()).alias("unreadable"))

    one = F.lit(1)
    return (
        F.when(text.isNull() | (text == "") | has("受益権分割", "投資口分割"), made(None, None))
        .when(has("分割比率") & has("割当率") & ~has("株式分割", "株式併合") & factor.isNull(), made(None, None))
        .when(has("株式併合"), made(factor, "2"))
        .when(has("分割"), made(factor, "1"))
        .when(has("新株予約権"), made(one, "3"))
        .when(has("株主無償割当"), made(topped, "1"))
        .when(has("株主割当", "株式配当"), made(one, "3"))
        .otherwise(made(None, None))
    )


def filing_id(url: str | Column) -> Column:
    """The document id in a viewer's address, which has two shapes."""
    text = F.trim(url)
    path = F.regexp_extract(text, r"^https://[^/?#]+/[^?#]*/([A-Z][0-9A-Z]{7})\.pdf$", 1)
    query = F.regexp_extract(text, r"^https://[^/?#]+/[^?#]*\?(?:[^#]*&)?([A-Z][0-9A-Z]{7}),?(?:&[^#]*|,[^#]*)?$", 1)
    return F.coalesce(F.nullif(path, F.lit("")), F.nullif(query, F.lit("")))


def filing_url(url: str | Column, folder: str) -> Column:
    """The address of a filing's file in a folder; an address without an id stays as it is, none is blank."""
    given = url if isinstance(url, Column) else F.col(url)
    return F.coalesce(F.concat(F.lit(f"{folder}/"), filing_id(given), F.lit(".pdf")), given, F.lit(""))
