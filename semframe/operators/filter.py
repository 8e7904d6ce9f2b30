"""Semantic filter over records and whole files, with bands, context and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semframe.functions.templates import check_placeholders, template
from semframe.operators.sequence import over_neighbours
from semframe.plans.judge import Ask, Judge, cleaned
from semframe.sources.records import with_fields, with_neighbours

SELECTED, REJECTED, UNCERTAIN, FAILED = "selected", "rejected", "uncertain", "failed"


def decide(p: Column, threshold: float = 0.5, band: tuple[float, float] | None = None, invert: bool = False) -> Column:
    """The verdict on a probability.

    Without a band: selected iff ``(p >= threshold) != invert``.  With one, ``lo <= p <= hi`` is uncertain, also under
    invert, and yes means ``p > hi``.  A null probability has failed.
    """
    flip = F.lit(invert)
    if band is None:
        sure = F.when((p >= threshold) != flip, SELECTED).otherwise(REJECTED)
    else:
        lo, hi = band
        sure = F.when(p.between(lo, hi), UNCERTAIN).when((p > hi) != flip, SELECTED).otherwise(REJECTED)
    return F.when(p.isNull(), FAILED).otherwise(sure)


def _about(df: DataFrame, query: str, text: str, delimiter: str | None, window: int, group: Sequence[str]) -> tuple[DataFrame, dict[str, Column]]:
    check_placeholders(query, delimiter is not None)
    about: dict[str, Column] = {}
    if window:
        df = with_neighbours(df, window, group, text=text)
        about["before"] = F.col("before")
    about["text"] = cleaned(df, text)
    if delimiter is not None:
        import re

        df = with_fields(df, delimiter, text)
        for n in sorted({int(x) for x in re.findall(r"\{(\d+)\}", query)}):
            about[f"f{n}"] = F.coalesce(F.try_element_at(F.col("fields"), F.lit(n)), F.lit(""))
    if window:
        about["after"] = F.col("after")
    return df, about


def sem_filter(df: DataFrame, judge: Judge, query: str, *, text: str = "text", threshold: float = 0.5, band: tuple[float, float] | None = None,
               invert: bool = False, delimiter: str | None = None, window: int = 0, group: Sequence[str] = ("file_idx",),
               context: dict[str, str] | None = None, yes: str | None = None, no: str | None = None) -> DataFrame:
    """Every record with ``p``, ``verdict`` and ``error``; nothing is dropped, so filters, counts and context share one
    judged frame.  ``delimiter`` gives ``{1}`` and so on a meaning, ``window`` shows the judge neighbours.

    A null text is judged like an empty one; a failed record is neither selected nor rejected.
    """
    df, about = _about(df, query, text, delimiter, window, group)
    about["text"] = F.coalesce(about["text"], F.lit(""))
    out = judge.attach(df, Ask("noul", template(query), about, context=context or {}, yes=yes, no=no), "_answer")
    out = out.withColumn("p", F.col("_answer.noul")).withColumn("error", F.col("_answer.error"))
    return out.withColumn("verdict", decide(F.col("p"), threshold, band, invert)).drop("_answer", *(["before", "after"] if window else []))


def selected(judged: DataFrame, limit: int | None = None, by: Sequence[str] = ("file_idx", "num")) -> DataFrame:
    """The selected records; with ``limit`` the first of them over all inputs."""
    out = judged.where(F.col("verdict") == SELECTED)
    return out if limit is None else out.orderBy(*by).limit(limit)


def uncertain(judged: DataFrame) -> DataFrame:
    return judged.where(F.col("verdict") == UNCERTAIN)


def count_per_file(judged: DataFrame, files: DataFrame, group: Sequence[str] = ("file_idx", "file")) -> DataFrame:
    """Selected records of each input of ``files``, zero counts included."""
    n = selected(judged).groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    return files.select(*group).distinct().join(n, list(group), "left").withColumn("n", F.coalesce("n", F.lit(0)))


def totals(judged: DataFrame) -> DataFrame:
    """One row: how many records were selected, rejected, uncertain, failed."""
    return judged.agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in (SELECTED, REJECTED, UNCERTAIN, FAILED)])


def with_context(judged: DataFrame, before: int = 0, after: int = 0, limit: int | None = None, group: Sequence[str] = ("file_idx",)) -> DataFrame:
    """Selected records and their neighbours: ``match`` tells which, ``gap`` that a group of records begins after another.

    With ``limit`` only the first matches count, and records after the last of them were never judged: their ``p`` is null.
    One window over overlapping blocks of numbers, so a large file is not sorted in one task.
    """
    keys = [*group, "num"]
    hit = F.col("verdict") == SELECTED
    if limit is not None:
        hits = judged.where(hit).select(*keys).orderBy(*keys).limit(limit)
        last = hits.agg(F.max(F.struct(*keys))).scalar()
        judged = judged.withColumn("p", F.when(F.struct(*keys) <= last, F.col("p")))
        hit = hit & (F.struct(*keys) <= last)
    marked = judged.withColumn("_hit", F.coalesce(hit, F.lit(False)).cast("int"))
    # a match lies from ``after`` records before to ``before`` records behind; and so for the record before
    near = {
        "_near": lambda w: F.max("_hit").over(w.rowsBetween(-after, before)),
        "_prev": lambda w: F.coalesce(F.max("_hit").over(w.rowsBetween(-after - 1, before - 1)), F.lit(0)),
    }
    out = over_neighbours(marked, near, max(before, after) + 1, group).where("_near = 1")
    first = out.groupBy().agg(F.min(F.struct(*keys))).scalar()
    gap = ((F.col("_prev") == 0) | (F.col("num") == 1)) & (F.struct(*keys) != first)
    return out.withColumn("match", F.col("_hit") == 1).withColumn("gap", gap).drop("_hit", "_near", "_prev", "verdict")


def sem_filter_files(chunks: DataFrame, judge: Judge, query: str, *, threshold: float = 0.5, band: tuple[float, float] | None = None,
                     invert: bool = False, context: dict[str, str] | None = None, group: Sequence[str] = ("file_idx", "file")) -> DataFrame:
    """Files by their best chunk: ``group``, ``p`` (null if no chunk was judged), ``failed`` chunks and ``verdict``."""
    check_placeholders(query, False)
    question = template(query).replace("`text`", "`document`")
    ask = Ask("noul", question, {"name": F.col(group[-1]), "document": cleaned(chunks)}, context=context or {})
    best = judge.attach(chunks, ask, "_answer").groupBy(*group).agg(
        F.max("_answer.noul").alias("p"), F.count_if(F.col("_answer.error").isNotNull()).alias("failed")
    )
    return best.withColumn("verdict", decide(F.col("p"), threshold, band, invert))


def file_chunk_budget(context_tokens: int, total: int = 20_000, least: int = 2_000) -> int:
    """Tokens a chunk may have beside the shared context; an error if hardly any are left."""
    left = total - context_tokens
    if left < least:
        raise ValueError("the context leaves no room for the files")
    return left
