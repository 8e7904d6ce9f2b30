"""Collapse adjacent records that mean the same into runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semframe.functions.templates import has_placeholder, rewrite_placeholders
from semframe.operators.sequence import beside_pair, judge_where, running_sum, with_shifted
from semframe.plans.judge import Ask, Judge
from semframe.functions.text import clean


def pair_question(question: str | None) -> str:
    """Pairs are asked about as ``f1`` and ``f2``."""
    if question is None:
        return "Do `f1` and `f2` mean the same?"
    return rewrite_placeholders(question) if has_placeholder(question) else f"Regarding `f1` and `f2`: {question}"


def with_runs(df: DataFrame, judge: Judge, question: str | None = None, *, threshold: float = 0.5, group: Sequence[str] = ("file_idx",),
              text: str = "text", context: dict[str, str] | None = None, around: int = 0) -> DataFrame:
    """Every record with ``p`` against the record before it (null for the first), ``error``, and its ``run`` from 1.

    Only neighbours are compared (``around`` shows the judge so many further records on either side); a failed comparison counts as different.  ``num`` must be dense within the group.
    """
    kept = df.withColumn("_text", F.coalesce(clean(F.col(text)), F.lit("")))
    paired = with_shifted(kept, {"_text": "_before"}, -1, group)
    about = {"f1": F.col("_before"), "f2": F.col("_text")}
    if around:
        paired, about = beside_pair(paired, about, around, group)
    ask = Ask("noul", pair_question(question), about, context=context or {})
    judged = judge_where(paired, judge, ask, "_answer", F.col("_before").isNotNull())
    judged = judged.withColumn("p", F.col("_answer.noul")).withColumn("error", F.col("_answer.error"))
    same = F.coalesce(F.col("error").isNull() & (F.col("p") >= threshold), F.lit(False))
    return running_sum(judged, F.when(same, 0).otherwise(1), "run", group).drop("_answer", "_text", "_before", "_earlier", "_later")


def sem_collapse(df: DataFrame, judge: Judge, question: str | None = None, *, keep: str = "first", threshold: float = 0.5,
                 group: Sequence[str] = ("file_idx",), text: str = "text", context: dict[str, str] | None = None, around: int = 0) -> DataFrame:
    """Runs of records that mean the same.

    ``keep``: ``first`` the head of every run, ``repeated`` the heads of runs of two or more, ``unique`` the runs of one: with
    ``n`` records, the head's ``num`` and text, its ``p``.  ``all`` every record of runs of two or more.
    """
    runs = with_runs(df, judge, question, threshold=threshold, group=group, text=text, context=context, around=around)
    sizes = runs.groupBy(*group, "run").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("num", F.col(text).alias("text"), "p")).alias("head"))
    if keep == "all":
        long = sizes.where("n > 1").select(*group, "run", "n")
        return runs.join(long, [*group, "run"])
    out = sizes.select(*group, "run", "n", F.col("head.num").alias("num"), F.col("head.text").alias(text), F.col("head.p").alias("p"))
    return {"first": out, "repeated": out.where("n > 1"), "unique": out.where("n = 1")}[keep]
