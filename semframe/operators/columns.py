"""Project the columns of a table that descriptions mean."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semframe.functions.templates import Label
from semframe.operators.test import NO, UNCERTAIN, YES
from semframe.plans.judge import Ask, ExprJudge, Judge, answer

# Columns a table may have, rows shown of each and how much of a cell.
MAX_COLUMNS, SAMPLES, CELL = 254, 5, 80
NONE = "none"


def header_oracle(low: float = 0.8) -> ExprJudge:
    """Chooses the first column whose header occurs in the description, else none."""

    def choice(ask: Ask) -> Column:
        s = F.lower(ask.about["description"])
        won = F.lit(None).cast("string")
        for o in reversed(ask.options):
            if o.description and o.name != NONE:
                won = F.when(s.contains(o.description.lower()), F.lit(o.name)).otherwise(won)
        conf = F.when(s.contains("unsure"), 0.3).otherwise(low)
        return answer(choice=F.coalesce(won, F.lit(NONE)), confidence=conf)

    return ExprJudge(None, choice, None)


def pick_columns(spark: SparkSession, judge: Judge, headers: Sequence[str], samples: Sequence[Sequence[str]], descriptions: Sequence[str],
                 threshold: float = 0.5) -> tuple[str, list[int], list[dict]]:
    """``(verdict, columns, choices)``: for each description the 0-based column it means; the same column may be meant twice.

    A description that no column fits makes the verdict *no*, which wins over *uncertain* (a confidence under the
    threshold); in either case nothing should be projected.
    """
    if len(headers) > MAX_COLUMNS:
        raise ValueError(f"more than {MAX_COLUMNS} columns")
    shown = [{"id": f"c{i}", "header": h, "samples": [str(r[i - 1])[:CELL] if len(r) >= i else "" for r in samples[:SAMPLES]]} for i, h in enumerate(headers, 1)]
    options = tuple(Label(f"c{i}", h) for i, h in enumerate(headers, 1)) + (Label(NONE, "no column fits"),)
    asks = spark.createDataFrame([(i, d) for i, d in enumerate(descriptions)], "i int, description string")
    ask = Ask("choice", "Which column does `description` mean?", {"description": F.col("description")}, options=options, context={"columns": json.dumps(shown, ensure_ascii=False)})
    got = judge.attach(asks, ask, "_answer").select("i", "_answer.*").orderBy("i").collect()  # one row per description
    bad = [r for r in got if r["error"] is not None]
    if bad:
        raise RuntimeError(bad[0]["error"])
    choices = [{"description": d, "choice": r["choice"], "confidence": r["confidence"]} for d, r in zip(descriptions, got)]
    if any(c["choice"] == NONE for c in choices):
        return NO, [], choices
    if any(c["confidence"] < threshold for c in choices):
        return UNCERTAIN, [], choices
    return YES, [int(c["choice"][1:]) - 1 for c in choices], choices


def sem_columns(df: DataFrame, judge: Judge, descriptions: Sequence[str], threshold: float = 0.5) -> tuple[str, DataFrame]:
    """``(verdict, projected)``: the meant columns of a frame in the order of the descriptions; no columns unless *yes*.

    Five rows are shown to the judge; a repeated column gets a suffix."""
    rows = [["" if v is None else str(v) for v in r] for r in df.limit(SAMPLES).collect()]
    verdict, cols, _ = pick_columns(df.sparkSession, judge, df.columns, rows, descriptions, threshold)
    names, seen = [], {}
    for c in cols:
        name = df.columns[c]
        seen[name] = seen.get(name, 0) + 1
        names.append(F.col(f"`{name}`").alias(name if seen[name] == 1 else f"{name}_{seen[name]}"))
    return verdict, df.select(*names)


def project_cells(rows: DataFrame, columns: Sequence[int], cells: str = "cells") -> DataFrame:
    """Ragged rows of strings cut to the columns, short rows padded with empty cells."""
    return rows.withColumn(cells, F.array(*[F.coalesce(F.try_element_at(F.col(cells), F.lit(c + 1)), F.lit("")) for c in columns]))
