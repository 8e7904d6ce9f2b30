"""Registered queries of the data-processing operators in the core: strict loading and rolling totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from semframe.operators.rolling import rolling_totals
from semframe.session import table
from semframe.sources import strict_rows as strict


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return strict.rejects(table(spark, d, "csv_rows")).select("file", "num")


def p1_rejects(spark: SparkSession, d: str) -> DataFrame:
    return strict.rejects(table(spark, d, "csv_rows"))


def p1_users(spark: SparkSession, d: str) -> DataFrame:
    return strict.strict_load(strict.raw_lines(table(spark, d, "csv_rows")), strict.USERS).drop("text")


def p1_cutv_export(spark: SparkSession, d: str) -> DataFrame:
    return strict.strict_load(strict.raw_lines(table(spark, d, "csv_rows")), strict.CUTV_EXPORT).drop("text")


def p3_rolling(spark: SparkSession, d: str) -> DataFrame:
    return rolling_totals(table(spark, d, "ledger"))


QUERIES = {f.__name__: f for f in (p1_found, p1_rejects, p1_users, p1_cutv_export, p3_rolling)}

_D = r"""CASE WHEN contains(h, chr(9)) THEN chr(9) WHEN contains(h, ',') THEN ',' ELSE ';' END"""


def _fields(d: str) -> str:
    """DuckDB: the fields of a line at delimiter ``d``, null where its quoting is broken.  Each match begins with a delimiter: an
    empty one at the start of a line would end the search for the next."""
    one = rf'(?:"(?:[^"]|"")*"|[^"{d}]*)'
    return (
        rf"""CASE WHEN regexp_full_match(line, '{one}(?:{d}{one})*', 's')"""
        rf""" THEN list_transform(regexp_extract_all('{d}' || line, '{d}("(?:[^"]|"")*"|[^"{d}]*)', 1, 's'),"""
        r""" lambda x: CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END) END"""
    )


_MAIL = r"(v = '' OR regexp_full_match(v, '[^@\s\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]+@[^@\s\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]+'))"
_RULES = {
    "id": "regexp_full_match(v, '[0-9]{1,9}')",
    "person": r"(regexp_matches(v, '\p{L}') AND NOT regexp_matches(v, '[\p{Cc}\x{FFFD}]'))",
    "mail": _MAIL,
    "date": "(regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND TRY_CAST(v AS DATE) IS NOT NULL)",
    "time": "(regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]Z') AND TRY_CAST(v[1:10] AS DATE) IS NOT NULL)",
    "money": r"(v = '' OR regexp_full_match(v, '[0-9]+(\.[0-9]{2})?'))",
}


def _rule(kind: str, i: int) -> str:
    v = f"f[{i + 1}]"
    if kind == "free":
        return "TRUE"
    if kind.startswith("enum:"):
        return f"{v} IN ({', '.join(repr(x) for x in kind[5:].split('|'))})"
    import re

    return re.sub(r"\bv\b(?=[,\[\] ])", v, _RULES[kind])


def _valid(layout: strict.Layout) -> str:
    return " AND ".join([f"len(f) = {len(layout.fields)}"] + [_rule(x.kind, i) for i, x in enumerate(layout.fields)])


_LINES = rf"""
WITH head AS (SELECT file, any_value(text) h FROM csv_rows WHERE num = 1 GROUP BY file),
raw AS (SELECT r.file, r.num, r.text, regexp_replace(r.text, '\r$', '') line, h, {_D} d
        FROM csv_rows r JOIN head USING (file) WHERE r.num <> 1 AND r.text NOT IN ('', chr(13))),
parsed AS (SELECT file, num, text, contains(h, 'Full Name') is_users,
                  CASE d WHEN ',' THEN {_fields(',')} WHEN ';' THEN {_fields(';')} ELSE string_split(line, chr(9)) END f FROM raw)
"""
_BAD_USERS, _BAD_CUTV = (f"(f IS NULL OR NOT ({_valid(x)}))" for x in (strict.USERS, strict.CUTV_EXPORT))
_FOUND = _LINES + f" SELECT file, num@more@ FROM parsed WHERE CASE WHEN is_users THEN {_BAD_USERS} ELSE {_BAD_CUTV} END"


def _reasons() -> str:
    def one(layout: strict.Layout) -> str:
        n = len(layout.fields)
        cases = f"WHEN len(f) < {n} THEN 'too_few_columns' WHEN len(f) > {n} THEN 'too_many_columns' "
        return cases + " ".join(f"WHEN NOT {_rule(x.kind, i)} THEN 'value:{x.name}'" for i, x in enumerate(layout.fields) if x.kind != "free")

    return (
        f", text, CASE WHEN f IS NULL THEN 'broken_quoting' WHEN is_users THEN CASE {one(strict.USERS)} END"
        f" ELSE CASE {one(strict.CUTV_EXPORT)} END END AS reason"
    )


_TYPES = {"id": "CAST({v} AS BIGINT)", "date": "CAST({v} AS DATE)", "time": "strptime({v}, '%Y-%m-%dT%H:%M:%SZ')", "money": "TRY_CAST(NULLIF({v}, '') AS DOUBLE)"}


def _load(layout: strict.Layout, users: bool) -> str:
    cols = ", ".join(_TYPES.get(x.kind, "{v}").format(v=f"f[{i + 1}]") + f" AS {x.out}" for i, x in enumerate(layout.fields))
    return _LINES + f" SELECT file, num, {cols} FROM parsed WHERE is_users = {users} AND f IS NOT NULL AND {_valid(layout)}"


_ROLL = """
WITH e AS (SELECT DISTINCT ON (entry_id) * FROM ledger ORDER BY entry_id, recorded_at),
d AS (SELECT tool, day, CAST(coalesce(sum(CAST(round(usd * 1000000) AS BIGINT)), 0) AS BIGINT) m, CAST(coalesce(sum(tokens), 0) AS BIGINT) t
      FROM e WHERE day IS NOT NULL GROUP BY ALL),
span AS (SELECT tool, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM d GROUP BY tool),
s AS (SELECT tool, day, coalesce(m, 0) m, coalesce(t, 0) t FROM span LEFT JOIN d USING (tool, day))
SELECT tool, day, m / 1e6 AS usd, CAST(t AS BIGINT) AS tokens,
{cols}
FROM s WINDOW {wins}
"""


def _roll_sql(windows: tuple[int, ...] = (7, 30)) -> str:
    cols = ",\n".join(
        f"CAST(sum(m) OVER w{w} AS DOUBLE) / 1e6 AS usd_{w}, CAST(sum(t) OVER w{w} AS BIGINT) AS tokens_{w}, CAST(sum(m) OVER w{w} AS DOUBLE) / 1e6 / count(*) OVER w{w} AS avg_usd_{w},"
        f" CAST(sum(t) OVER w{w} AS DOUBLE) / count(*) OVER w{w} AS avg_tokens_{w}, max(m) OVER w{w} / 1e6 AS max_usd_{w}"
        for w in windows
    )
    wins = ", ".join(f"w{w} AS (PARTITION BY tool ORDER BY day ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)" for w in windows)
    return _ROLL.format(cols=cols, wins=wins)


SQL = {
    "p1_found": _FOUND.replace("@more@", ""),
    "p1_rejects": _FOUND.replace("@more@", _reasons()),
    "p1_users": _load(strict.USERS, True),
    "p1_cutv_export": _load(strict.CUTV_EXPORT, False),
    "p3_rolling": _roll_sql(),
}
