"""One answer for a whole input: a yes/no test over chunks, a choice, and ad-hoc questions about one state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semframe.functions.templates import Label
from semframe.plans.judge import Ask, Judge, cleaned

__test__ = False  # not a test module
YES, NO, UNCERTAIN, ERROR = "yes", "no", "uncertain", "error"
COMBINE = {"any": F.max, "all": F.min, "mean": F.avg}


def verdict_of(p: Column, threshold: float = 0.5, band: tuple[float, float] | None = None, invert: bool = False) -> Column:
    """yes or no, swapped by ``invert``; a probability within the band is uncertain either way."""
    sure = (p >= threshold) if band is None else (p > band[1])
    v = F.when(sure != F.lit(invert), YES).otherwise(NO)
    return v if band is None else F.when(p.between(*band), UNCERTAIN).otherwise(v)


def sem_test(df: DataFrame, judge: Judge, question: str, *, combine: str = "any", threshold: float = 0.5, band: tuple[float, float] | None = None,
             invert: bool = False, group: Sequence[str] = (), text: str = "text", context: dict[str, str] | None = None) -> DataFrame:
    """``p`` and ``verdict`` for each group (one row without groups): the chunks' probabilities combined by any, all or mean.

    The question is asked as it stands.  A failed chunk makes the verdict ``error``; so does an input of white space only.
    """
    judged = judge.attach(df, Ask("noul", question, {"input": F.coalesce(cleaned(df, text), F.lit(""))}, context=context or {}), "_answer")
    out = judged.groupBy(*group).agg(
        COMBINE[combine]("_answer.noul").alias("p"), F.count_if(F.col("_answer.error").isNotNull()).alias("failed"),
        F.max(F.coalesce(F.col(text), F.lit("")).rlike("(?U)\\S")).alias("_some"),
    )
    v = F.when((F.col("failed") > 0) | ~F.coalesce("_some", F.lit(False)), ERROR).otherwise(verdict_of(F.col("p"), threshold, band, invert))
    return out.withColumn("verdict", v).drop("_some")


def sem_choose(df: DataFrame, judge: Judge, labels: Sequence[Label], question: str = "Which option fits the input best?", *, other: str | None = None,
               threshold: float = 0.0, text: str = "text", context: dict[str, str] | None = None) -> DataFrame:
    """The label of each input with ``confidence``, ``probabilities`` and ``verdict``: *no* if the escape won, else
    *uncertain* below the threshold (the label is still there)."""
    options = tuple(labels) + ((Label(other),) if other else ())
    if len(labels) < 2 and not other or len(options) < 2:
        raise ValueError("a choice needs two options")
    judged = judge.attach(df, Ask("choice", question, {"input": F.coalesce(cleaned(df, text), F.lit(""))}, options=options, context=context or {}), "_answer")
    v = (
        F.when(F.col("_answer.error").isNotNull(), ERROR)
        .when(F.col("_answer.choice") == F.lit(other), NO)
        .when(F.col("_answer.confidence") < threshold, UNCERTAIN)
        .otherwise(YES)
    )
    return judged.withColumn("label", F.col("_answer.choice")).withColumn("confidence", F.col("_answer.confidence")).withColumn(
        "probabilities", F.col("_answer.probabilities")).withColumn("verdict", v).drop("_answer")


def distribution(chosen: DataFrame, labels: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The probabilities of ``sem_choose`` as rows ``place, label, p``: falling, equal ones in option order."""
    pairs = F.array(*[F.struct(F.lit(-1.0) * F.col("probabilities")[x], F.lit(i).alias("i"), F.lit(x).alias("label")) for i, x in enumerate(labels)])
    return chosen.select(*keep, F.posexplode(F.array_sort(pairs)).alias("place", "_x")).select(
        *keep, (F.col("place") + 1).alias("place"), F.col("_x.label").alias("label"), (-F.col("_x.col1")).alias("p")
    )


def sem_ask(df: DataFrame, judge: Judge, specs: Sequence, text: str = "text") -> DataFrame:
    """Ad-hoc questions about one state: the probe operator over a frame of one row."""
    from semframe.operators.probe import sem_probe

    return sem_probe(df, judge, specs, text=text)
