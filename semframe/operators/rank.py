"""Sort by how well records fit, or by ordered levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semframe.functions.templates import MAX_LEVELS, has_placeholder, rewrite_placeholders, template
from semframe.plans.judge import Ask, Judge, cleaned
from semframe.sources.records import with_neighbours


def sem_rank(df: DataFrame, judge: Judge, query: str, *, levels: Sequence[str] = (), reverse: bool = False, top: int | None = None,
             ties: Sequence[str] = ("file_idx", "num"), text: str = "text", context: dict[str, str] | None = None, window: int = 0,
             group: Sequence[str] = ("file_idx",)) -> DataFrame:
    """Records with ``score`` and ``error``, best first (``reverse``: worst first); failed ones last either way.

    ``ties`` makes the order total, as Spark's sort is not stable.  ``top`` becomes a top-k, not a full sort.
    """
    if levels and not 2 <= len(levels) <= MAX_LEVELS:
        raise ValueError(f"levels are 2 to {MAX_LEVELS}")
    if levels:
        q = rewrite_placeholders(query) if has_placeholder(query) else f"Regarding `text`: {query}"
    else:
        q = template(query)
    if window:  # so many records on either side are shown with each
        df = with_neighbours(df, window, group, text=text)
    about = {"text": F.coalesce(cleaned(df, text), F.lit(""))}
    if window:
        about = {"before": F.col("before"), **about, "after": F.col("after")}
    ask = Ask("score" if levels else "noul", q, about, levels=tuple(levels), context=context or {})
    out = judge.attach(df, ask, "_answer")
    out = out.withColumn("score", F.col("_answer.score" if levels else "_answer.noul")).withColumn("error", F.col("_answer.error")).drop("_answer", *(["before", "after"] if window else []))
    by = F.col("score").asc_nulls_last() if reverse else F.col("score").desc_nulls_last()
    out = out.orderBy(by, *ties)
    return out if top is None else out.limit(top)
