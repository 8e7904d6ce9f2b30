"""Where the answer flips in ordered records: a k-ary search that asks about a few records per round."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semframe.functions.templates import template
from semframe.operators.sequence import with_position
from semframe.operators.test import NO, UNCERTAIN, YES
from semframe.plans.judge import Ask, Judge, cleaned
from semframe.sources.records import with_neighbours

PROBES = 16
#: Neighbours on either side that the verification shows at least.
VERIFIED_WITH = 3


@dataclass
class Flip:
    """The result of a search: ``pos`` 0-based (null: no flip), the rounds as ``(asked, lower, upper)``, inversions seen."""

    pos: int | None
    verdict: str
    p: float | None = None
    already: bool = False
    questions: int = 0
    rounds: list[tuple[list[int], int, int]] = field(default_factory=list)
    inversions: list[int] = field(default_factory=list)


def probes(lower: int, upper: int, n: int, k: int, first: bool) -> list[int]:
    """Records to ask about in the open interval: all if at most ``k``; else evenly spread, the ends of the input first in the
    first round, until there are ``k``."""
    span = upper - lower
    if span - 1 <= k:
        return list(range(lower + 1, upper))
    out: list[int] = [0, n - 1] if first else []
    for j in range(1, k + 1):
        if len(out) >= k:
            break
        i = lower + math.floor(j * span / (k + 1) + 0.5)
        if lower < i < upper and i not in out:
            out.append(i)
    i = lower + 1
    while len(out) < k and i < upper:
        if i not in out:
            out.append(i)
        i += 1
    return sorted(out)


def sem_bisect(df: DataFrame, judge: Judge, query: str, *, by: list[str | Column] | None = None, k: int = PROBES, threshold: float = 0.5,
               band: tuple[float, float] | None = None, invert: bool = False, verify: bool = False, text: str = "text",
               context: dict[str, str] | None = None, window: int = 0) -> tuple[Flip, DataFrame]:
    """``(flip, positioned)``: the first record from which on the answer is yes, and the records with ``pos``.

    Each round reads at most ``k`` positions, with ``window`` records on either side of each.  A *no* after a known *yes* is an inversion: noted, and the search
    goes on to the first yes.  A band hit on the flip or its predecessor, or disagreement with ``verify``, is *uncertain*.
    """
    by = by or ["file_idx", "num"]
    rows = with_position(df.withColumn("_text", F.coalesce(cleaned(df, text), F.lit(""))), by, "pos")
    n = rows.count()
    if not n:
        return Flip(None, NO), rows.drop("_text")
    def ask(window: int) -> Ask:
        about = {"text": F.col("_text")}
        if window:
            about = {"before": F.col("before"), **about, "after": F.col("after")}
        return Ask("noul", template(query), about, context=context or {})

    def at_positions(at: list[int], window: int) -> DataFrame:
        if not window:
            return rows.where(F.col("pos").isin(at))
        some = rows.where(F.col("pos").isin(sorted({i + j for i in at for j in range(-window, window + 1)})))
        near = with_neighbours(some.withColumn("_all", F.lit(0)), window, ["_all"], text="_text", num="pos").drop("_all")
        return near.where(F.col("pos").isin(at))

    def is_yes(p: float) -> bool:
        return ((p > band[1]) if band else (p >= threshold)) != invert

    def answers(at: list[int], window: int = window) -> dict[int, float]:
        got = judge.attach(at_positions(at, window), ask(window), "_answer").select("pos", "_answer.noul", "_answer.error").collect()  # at most k rows
        bad = [r for r in got if r["error"] is not None]
        if bad:
            raise RuntimeError(f"record {bad[0]['pos'] + 1}: {bad[0]['error']}")
        return {r["pos"]: r["noul"] for r in got}

    known: dict[int, float] = {}
    lower, upper = -1, n
    flip = Flip(None, NO)
    while upper - lower > 1:
        fresh = [i for i in probes(lower, upper, n, k, not flip.rounds) if i not in known]
        if not fresh:
            break
        known |= answers(fresh)
        inside = sorted(i for i in known if lower < i < upper)
        yes = next((i for i in inside if is_yes(known[i])), None)
        if yes is not None:
            flip.inversions += [i for i in inside if i > yes and not is_yes(known[i]) and i not in flip.inversions]
            upper = yes
        lower = max([lower] + [i for i in inside if i < upper and not is_yes(known[i])])
        flip.rounds.append((fresh, lower, upper))
    flip.questions = len(known)
    if upper == n:
        return flip, rows.drop("_text")
    flip.pos, flip.p, flip.already = upper, known[upper], upper == 0
    doubt = band is not None and any(band[0] <= known[i] <= band[1] for i in (upper, upper - 1) if i in known)
    if verify:
        again = answers([i for i in (upper - 1, upper) if i >= 0], max(window, VERIFIED_WITH))
        doubt |= not is_yes(again[upper]) or (upper > 0 and is_yes(again[upper - 1]))
    flip.verdict = UNCERTAIN if doubt else YES
    return flip, rows.drop("_text")


def around(positioned: DataFrame, flip: Flip, before: int = 0, after: int = 0) -> DataFrame:
    """The flip and its neighbours, ``match`` telling which; empty without a flip."""
    at = -1 - before - after if flip.pos is None else flip.pos
    return positioned.where(F.col("pos").between(at - before, at + after)).withColumn("match", F.col("pos") == at)
