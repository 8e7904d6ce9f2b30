"""Text output: prefixes, separators, verdicts as exit codes.  Frames keep raw values; rounding happens only here."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from enum import IntEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semframe.sources.records import LINES, SEPARATORS


class Verdict(IntEnum):
    """Exit codes are part of the interface."""

    YES = 0
    NO = 1
    ERROR = 2
    UNCERTAIN = 3
    DECLINED = 4
    INTERRUPTED = 130


def score(p: float | None) -> str:
    """Two decimals, rounded on the binary value; ``-`` for a record that was not judged."""
    return "-" if p is None else "%.2f" % p


def ordered(df: DataFrame, by: Iterable[str] = ("file_idx", "num")) -> Iterator:
    """Rows in record order, pulled partition by partition: closing the iterator stops the rest."""
    return df.orderBy(*by).toLocalIterator()


def records(rows: Iterable, mode: str = LINES, *, files: bool = False, numbers: bool = False, scores: bool = False) -> Iterator[str]:
    """The lines of a filter's output: ``p``, file and number as asked, ``:`` after a match and ``-`` after a context record,
    ``--`` between groups."""
    for r in rows:
        d = r.asDict() if hasattr(r, "asDict") else r
        if d.get("gap"):
            yield "--\n"
        mark = ":" if d.get("match", True) else "-"
        out = f"{score(d.get('p'))}\t" if scores else ""
        out += f"{d['file']}{mark}" if files else ""
        out += f"{d['num']}{mark}" if numbers else ""
        yield out + (d["text"] or "") + SEPARATORS[mode]


def line_column(*, files: bool = False, numbers: bool = False, scores: bool = False, hit: Column | None = None) -> Column:
    """The same lines as a column, for output that is written by the executors."""
    mark = F.when(F.lit(True) if hit is None else hit, ":").otherwise("-")
    shown = F.when(F.col("p").isNull(), "-").otherwise(F.format_string("%.2f", F.col("p")))
    parts = [F.concat(shown, F.lit("\t"))] if scores else []
    parts += [F.concat(F.col("file").cast("string"), mark)] if files else []
    parts += [F.concat(F.col("num").cast("string"), mark)] if numbers else []
    return F.concat(*parts, F.coalesce("text", F.lit("")))


def runs(rows: Iterable, mode: str = LINES, *, counts: bool = False, scores: bool = False) -> Iterator[str]:
    for r in rows:
        d = r.asDict()
        out = f"{score(d['p'])}\t" if scores else ""
        yield out + (f"{d['n']:7d} " if counts else "") + (d["text"] or "") + SEPARATORS[mode]


def labelled(rows: Iterable, mode: str = LINES, *, scores: bool = False, hide: bool = False) -> Iterator[str]:
    for r in rows:
        d = r.asDict()
        out = f"{score(d['confidence'])}\t" if scores else ""
        yield out + ("" if hide else f"{d['label']}\t") + (d["text"] or "") + SEPARATORS[mode]


def segmented(rows: Iterable, mode: str = LINES, *, sep: str | None = None, scores: bool = False) -> Iterator[str]:
    base = sep if sep is not None else ("---" if scores or mode != LINES else "")
    for r in rows:
        d = r.asDict()
        if d["cut"]:
            yield base + (f" {score(d['p'])}" if scores else "") + SEPARATORS[mode]
        yield (d["text"] or "") + SEPARATORS[mode]


def verdict_of(selected: int, uncertain: int = 0, failed: int = 0) -> Verdict:
    """A failed record makes an error, a match yes, only uncertain records uncertain."""
    if failed:
        return Verdict.ERROR
    if selected:
        return Verdict.YES
    return Verdict.UNCERTAIN if uncertain else Verdict.NO


def usd(x: float) -> str:
    """A cost: four digits after the point, more for less."""
    return f"${x:.4f}" if x >= 0.001 or x == 0 else f"${x:.6f}"


def count(n: int) -> str:
    return f"{n:,}"


def tokens(n: int) -> str:
    return str(n) if n < 1000 else f"{n / 1000:.1f}k" if n < 1_000_000 else f"{n / 1e6:.1f}M"
