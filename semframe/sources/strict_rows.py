"""Strict loading of delimited lines, with every line that does not conform kept apart and explained.

Method: *strict load plus anti-join*.  The offset of every raw line is ``(file, num)``.  ``strict_load`` keeps only
lines that satisfy the whole layout (quoting, column count, every value) and types them.  ``rejects`` subtracts the
loaded offsets from the raw offsets with an anti join and diagnoses what remains.  Everything is a Catalyst
expression; no line passes through Python.

Defined cases
-------------
* one trailing CR is not part of a line; a line that is then empty is not a record; null text is not a record;
* the header is line 1 of its file and never a record; a file without line 1 has the reason ``no_header``;
* a file whose header is not exactly the columns of a known layout in their order has the reason ``unknown_layout``;
* tab files have no quoting; elsewhere a field is free of quotes, or wrapped in quotes as a whole with inner quotes
  doubled;
* a file of any share of all rows is fine: the header join is salted by line number, and the anti join is on the
  unique offset;
* columns other than ``file, num, text`` are ignored, so clashing names cannot matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Salts of the header join: rows of one file spread over so many tasks.
HEADER_SALTS = 16

_ESC = "\u0001"


@dataclass(frozen=True)
class Field:
    """A column of a layout: ``rule`` gives whether a raw value is admitted, ``typed`` the loaded value."""

    name: str
    out: str
    kind: str


@dataclass(frozen=True)
class Layout:
    name: str
    fields: tuple[Field, ...]


USERS = Layout(
    "users",
    (
        Field("id", "id", "id"),
        Field("Full Name", "full_name", "person"),
        Field("E-mail", "e_mail", "mail"),
        Field("Tel", "tel", "free"),
        Field("Signup", "signup", "date"),
        Field("Plan", "plan", "enum:free|pro|team|"),
    ),
)
CUTV_EXPORT = Layout(
    "cutv-export",
    (
        Field("cust_id", "cust_id", "id"),
        Field("acct_nm", "acct_nm", "free"),
        Field("prim_cntct", "prim_cntct", "free"),
        Field("prim_cntct_eml", "prim_cntct_eml", "mail"),
        Field("ph_1", "ph_1", "free"),
        Field("created_ts", "created_ts", "time"),
        Field("mrr_usd", "mrr_usd", "money"),
        Field("tier_cd", "tier_cd", "enum:STD|PRO|ENT|EDU|"),
        Field("rgn", "rgn", "free"),
    ),
)
LAYOUTS = (USERS, CUTV_EXPORT)


def admitted(value: Column, kind: str) -> Column:
    """Whether ``value`` is admitted by a column of ``kind``; never null for a non-null value."""
    if kind == "id":
        return value.rlike(r"\A[0-9]{1,9}\z")
    if kind == "person":
        return value.rlike(r"\p{L}") & ~value.rlike(r"[\p{Cc}\x{FFFD}]")
    if kind == "mail":
        return (value == "") | value.rlike(r"(?U)\A[^@\s]+@[^@\s]+\z")
    if kind == "date":
        return value.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & _real_date(value)
    if kind == "time":
        return (
            value.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]Z\z")
            & _real_date(F.substring(value, 1, 10))
        )
    if kind == "money":
        return (value == "") | value.rlike(r"\A[0-9]+(\.[0-9]{2})?\z")
    if kind.startswith("enum:"):
        return value.isin(*kind[5:].split("|"))
    return F.lit(True)


def _real_date(value: Column) -> Column:
    return value.try_cast("date").isNotNull() & ~value.startswith("0000")


def typed(value: Column, kind: str) -> Column:
    """The loaded form of an admitted value; the empty string becomes null in typed columns."""
    if kind == "id":
        return value.try_cast("bigint")
    if kind == "date":
        return value.try_cast("date")
    if kind == "time":
        return F.try_to_timestamp(F.regexp_replace(value, r"[TZ]", " "), F.lit("yyyy-MM-dd HH:mm:ss "))
    if kind == "money":
        return value.try_cast("double")
    return value


def delimiter_of(header: Column) -> Column:
    """Tab if the header holds one, else comma, else semicolon, else comma."""
    return F.when(header.contains("\t"), "\t").when(header.contains(","), ",").when(header.contains(";"), ";").otherwise(",")


def _trim_cr(text: Column) -> Column:
    return F.when(text.endswith("\r"), F.expr("substring(text, 1, length(text) - 1)")).otherwise(text)


def _quotes_ok(parts: Column, d: Column) -> Column:
    """``parts`` is the line split at quotes: even positions lie outside quotes, odd ones inside."""
    last = F.size(parts) - 1

    def outside(x: Column, i: Column) -> Column:
        opens, closes = F.endswith(x, d), F.startswith(x, d)
        return (
            (i % 2 == 1)
            | (x == "")
            | F.when(i == 0, opens).when(i == last, closes).otherwise(opens & closes)
        )

    return (F.size(parts) % 2 == 1) & F.forall(F.transform(parts, outside), lambda ok: ok)


def _quoted_fields(parts: Column, d: Column) -> Column:
    """Fields of a well quoted line.  Delimiters inside quotes are escaped, the line is split, the escapes undone."""
    last = F.size(parts) - 1

    def piece(x: Column, i: Column) -> Column:
        safe = F.replace(x, F.lit(_ESC), F.lit(_ESC + "a"))
        return (
            F.when(i % 2 == 1, F.replace(safe, d, F.lit(_ESC + "b")))
            .when((x == "") & (i > 0) & (i < last), F.lit('"'))
            .otherwise(safe)
        )

    line = F.array_join(F.transform(parts, piece), "")
    return F.transform(
        _split(line, d),
        lambda f: F.replace(F.replace(f, F.lit(_ESC + "b"), d), F.lit(_ESC + "a"), F.lit(_ESC)),
    )


def _split(line: Column, d: Column) -> Column:
    # the three delimiters are plain characters in a regular expression
    return F.split(line, d, -1)


def raw_lines(rows: DataFrame) -> DataFrame:
    """``file, num, text, header``: the records of ``rows``, each with its file's header."""
    base = rows.select("file", F.col("num").cast("bigint").alias("num"), "text")
    # file ids may be null: <=> would prevent a hash join, so a null name becomes its own key
    keyed = base.withColumn("_file", F.coalesce(F.concat(F.lit("f"), F.col("file")), F.lit("n")))
    header = (
        keyed.where(F.col("num") == 1)
        .groupBy("_file")
        .agg(F.min(_trim_cr(F.col("text"))).alias("header"))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(HEADER_SALTS - 1))))
    )
    records = (
        keyed.where((F.col("num") != 1) & F.col("text").isNotNull() & ~F.col("text").isin("", "\r"))
        .withColumn("_salt", F.pmod(F.col("num"), F.lit(HEADER_SALTS)).cast("int"))
    )
    return records.join(header, ["_file", "_salt"], "left").select("file", "num", "text", "header")


def _parsed(lines: DataFrame) -> DataFrame:
    d = F.col("_d")
    parts = F.split(F.col("_line"), '"', -1)
    quoted = (d != "\t") & F.col("_line").contains('"')
    layout = F.lit(None).cast("string")
    for x in reversed(LAYOUTS):
        # all the columns in their order: a file that only mentions one of them is not loaded by position
        named = F.replace("header", F.lit('"'), F.lit("")).isin(*[sep.join(f.name for f in x.fields) for sep in ("\t", ",", ";")])
        layout = F.when(named, x.name).otherwise(layout)
    return (
        lines.withColumn("_line", _trim_cr(F.col("text")))
        .withColumn("_d", delimiter_of(F.col("header")))
        .withColumn("_layout", layout)
        .withColumn("_quoting", F.when(quoted, _quotes_ok(parts, d)).otherwise(F.lit(True)))
        .withColumn(
            "_fields",
            F.when(~F.col("_quoting"), F.lit(None).cast("array<string>"))
            .when(quoted, _quoted_fields(parts, d))
            .otherwise(_split(F.col("_line"), d)),
        )
    )


def _value(i: int) -> Column:
    return F.try_element_at(F.col("_fields"), F.lit(i + 1))


def strict_load(lines: DataFrame, layout: Layout) -> DataFrame:
    """Typed rows of ``layout`` from ``raw_lines``: ``file, num`` and the layout's columns.  Only conforming lines."""
    ok = (F.col("_layout") == layout.name) & F.col("_quoting") & (F.size("_fields") == len(layout.fields))
    for i, f in enumerate(layout.fields):
        ok &= admitted(_value(i), f.kind)
    return (
        _parsed(lines)
        .where(ok)
        .select("file", "num", "text", *[typed(_value(i), f.kind).alias(f.out) for i, f in enumerate(layout.fields)])
    )


def _reason() -> Column:
    values = F.lit("unexplained")
    for layout in LAYOUTS:
        bad = F.lit("unexplained")
        for i, f in reversed(list(enumerate(layout.fields))):
            bad = F.when(~admitted(_value(i), f.kind), f"value:{f.name}").otherwise(bad)
        n = F.size("_fields")
        bad = (
            F.when(n < len(layout.fields), "too_few_columns").when(n > len(layout.fields), "too_many_columns").otherwise(bad)
        )
        values = F.when(F.col("_layout") == layout.name, bad).otherwise(values)
    return (
        F.when(F.col("header").isNull(), "no_header")
        .when(F.col("_layout").isNull(), "unknown_layout")
        .when(~F.col("_quoting"), "broken_quoting")
        .otherwise(values)
    )


def rejects(rows: DataFrame) -> DataFrame:
    """``file, num, text, reason``: raw offsets minus loaded offsets, each with the first rule it breaks."""
    lines = raw_lines(rows)
    loaded = None
    for layout in LAYOUTS:
        part = strict_load(lines, layout).select(
            F.col("file").alias("_lf"), F.col("num").alias("_ln"), F.xxhash64("text").alias("_lh")
        )
        loaded = part if loaded is None else loaded.unionAll(part)
    rest = lines.join(
        loaded,
        F.col("file").eqNullSafe(F.col("_lf")) & F.col("num").eqNullSafe(F.col("_ln")) & (F.xxhash64("text") == F.col("_lh")),
        "left_anti",
    )
    return _parsed(rest).select("file", "num", "text", _reason().alias("reason"))
