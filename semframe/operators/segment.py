"""Cut a sequence of records where a new segment begins."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semframe.functions.templates import has_placeholder, rewrite_placeholders
from semframe.functions.text import clean
from semframe.operators.sequence import beside_pair, judge_where, running_sum, with_shifted
from semframe.operators.windows import ask_at_breaks
from semframe.plans.judge import Ask, BatchJudge, Judge


def boundary_question(question: str | None) -> str:
    if question is None:
        return "Does a new topic begin with `f2`?"
    if has_placeholder(question):
        return rewrite_placeholders(question)
    q = question.strip()
    return f"Regarding the boundary between `f1` and `f2`: {q}" if q.endswith("?") else f"Is it true that between `f1` and `f2` {q.removesuffix('.')}?"


# Boundaries of a window and its estimated tokens.
WINDOW, WINDOW_TOKENS = 64, 5_500


def boundary_at(question: str | None, tag: Column) -> Column:
    """The question about the record with an id, in a document of records."""
    if question is None:
        return F.concat(F.lit("Does a new topic begin with record "), tag, F.lit("?"))
    q = question.strip()
    if has_placeholder(q):  # the first field is the record before
        parts = re.split(r"\{(1|2|)\}", q)
        named = [F.lit(p) if i % 2 == 0 else F.concat(F.lit("the record before "), tag) if p == "1" else F.concat(F.lit("record "), tag) for i, p in enumerate(parts)]
        return F.concat(*named)
    said = F.lit(f": {q}" if q.endswith("?") else f", is it true that {q.removesuffix('.')}?")
    return F.concat(F.lit("Regarding the boundary before record "), tag, said)


def _keep_min(group: Sequence[str], least: int):
    """Greedy choice among the possible cuts, in order: a cut counts if enough records have passed since the last one."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, 1
        for batch in batches:
            keep = []
            for row in batch[[*group, "num"]].itertuples(index=False):
                if key != row[:-1]:
                    key, last = row[:-1], 1
                keep.append(row[-1] - last >= least)
                if keep[-1]:
                    last = row[-1]
            yield batch[keep]

    return fold


def sem_segment(df: DataFrame, judge: Judge, question: str | None = None, *, threshold: float = 0.5, min_len: int = 1,
                group: Sequence[str] = ("file_idx",), text: str = "text", context: dict[str, str] | None = None, around: int = 0) -> DataFrame:
    """Every record with ``p`` of the boundary before it (null for the first), ``cut`` and ``segment`` from 1.

    With ``min_len`` a cut is made iff the boundary fits and the segment before it has so many records; only the possible cuts
    go through that fold, in order and in constant memory.  A failed boundary is no cut.  ``num`` must be dense from 1.

    A judge by packed requests is asked about all boundaries of a window in one request, with the records as its document;
    ``around`` shows so many further records on either side.
    """
    kept = df.withColumn("_text", F.coalesce(clean(F.col(text)), F.lit("")))
    if isinstance(judge, BatchJudge):
        judged = ask_at_breaks(kept, judge, F.col("num") > 1, lambda tag: boundary_at(question, tag), group=group, text="_text", size=WINDOW, tokens=WINDOW_TOKENS, prefix="R", around=around, context=context)
        judged = judged.withColumn("_before", F.lit(None).cast("string"))
    else:
        paired = with_shifted(kept, {"_text": "_before"}, -1, group)
        about = {"f1": F.col("_before"), "f2": F.col("_text")}
        if around:
            paired, about = beside_pair(paired, about, around, group)
        judged = judge_where(paired, judge, Ask("noul", boundary_question(question), about, context=context or {}), "_answer", F.col("_before").isNotNull())
    judged = judged.withColumn("p", F.col("_answer.noul")).withColumn("error", F.col("_answer.error")).drop("_answer", "_text", "_before", "_earlier", "_later")
    fits = F.coalesce(F.col("error").isNull() & (F.col("p") >= threshold), F.lit(False))
    if min_len <= 1:
        judged = judged.withColumn("cut", fits)
    else:
        possible = judged.where(fits).select(*group, "num")
        schema = possible.schema
        cuts = possible.repartition(*group).sortWithinPartitions(*group, "num").mapInPandas(_keep_min(group, min_len), schema).withColumn("cut", F.lit(True))
        judged = judged.join(cuts, [*group, "num"], "left").withColumn("cut", F.coalesce("cut", F.lit(False)))
    return running_sum(judged, F.col("cut").cast("int"), "segment", group).withColumn("segment", F.col("segment") + 1)


def segments(segmented: DataFrame, group: Sequence[str] = ("file_idx",)) -> DataFrame:
    """``segment, n, first, last, p``: one row per segment, ``p`` of the boundary it begins with."""
    return segmented.groupBy(*group, "segment").agg(
        F.count(F.lit(1)).alias("n"), F.min("num").alias("first"), F.max("num").alias("last"), F.min_by("p", "num").alias("p")
    )
