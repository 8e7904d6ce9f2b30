"""Choices whose options are rows: the children of a directory, of a taxonomy label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semframe.plans.judge import Ask, BatchJudge, Judge
from semframe.session import durable


class OptionJudge(Judge):
    """A judge of row options by expression: ``fits(text, option, hint)`` tells whether an option is meant.

    The first fitting option of a choice gets 0.9 and the others share 0.1; a lone option gets 1.  If none fits, ``fallback``
    (an option name, or ``last``) wins, or all are equal.  For yes/no questions about single options, a fit is 0.95, else 0.05.
    """

    def __init__(self, fits, fallback: str | None = None) -> None:
        self.fits, self.fallback = fits, fallback


def keyword_options(fallback: str | None = None) -> OptionJudge:
    """An option is meant if its name occurs in the text, in any case."""
    return OptionJudge(lambda text, option, hint: F.contains(F.lower(text), F.lower(option)), fallback)


def choose_among(rows: DataFrame, judge: Judge, key: Sequence[str], question: str, *, text: str, option: str, hint: str, place: str) -> DataFrame:
    """One choice per ``key`` among its rows: adds ``p`` (the options of a choice sum to 1) and ``error``."""
    if isinstance(judge, OptionJudge):
        w = Window.partitionBy(*key)
        fit: Column = judge.fits(F.col(text), F.col(option), F.col(hint))
        out = rows.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_won", F.min(F.when(fit, F.col(place))).over(w))
        if judge.fallback == "last":
            out = out.withColumn("_won", F.coalesce("_won", F.max(place).over(w)))
        elif judge.fallback is not None:
            out = out.withColumn("_won", F.coalesce("_won", F.min(F.when(F.col(option) == judge.fallback, F.col(place))).over(w)))
        p = (
            F.when(F.col("_n") == 1, 1.0)
            .when(F.col("_won").isNull(), 1.0 / F.col("_n"))
            .when(F.col(place) == F.col("_won"), 0.9)
            .otherwise(0.1 / (F.col("_n") - 1))
        )
        return out.withColumn("p", p).withColumn("error", F.lit(None).cast("string")).drop("_n", "_won")
    if isinstance(judge, BatchJudge):
        rows = durable(rows)
        options = F.transform(F.sort_array(F.collect_list(F.struct(place, option, hint))), lambda x: F.struct(x[option].alias("option"), x[hint].alias("means")))
        asked = rows.groupBy(*key, text).agg(F.to_json(options).alias("_options"))
        judged = judge.attach(asked, Ask("choice", question, {"text": F.col(text), "options": F.col("_options")}), "_answer")
        answers = judged.select(*key, F.col("_answer.probabilities").alias("_probs"), F.col("_answer.error").alias("error"))
        return rows.join(answers, list(key)).withColumn("p", F.coalesce(F.try_element_at("_probs", F.col(option)), F.lit(0.0))).drop("_probs")
    raise ValueError("this judge does not choose among rows")


def each_option(rows: DataFrame, judge: Judge, question: str, *, text: str, option: str, hint: str) -> DataFrame:
    """One yes/no question per row: adds ``p`` and ``error``; the probabilities are absolute."""
    if isinstance(judge, OptionJudge):
        fit = judge.fits(F.col(text), F.col(option), F.col(hint))
        return rows.withColumn("p", F.when(fit, 0.95).otherwise(0.05)).withColumn("error", F.lit(None).cast("string"))
    out = judge.attach(rows, Ask("noul", question, {"text": F.col(text), "entry": F.col(option), "hint": F.col(hint)}), "_answer")
    return out.withColumn("p", F.col("_answer.noul")).withColumn("error", F.col("_answer.error")).drop("_answer")
