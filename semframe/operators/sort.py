"""Sort in an order described in words: a seed by levels, then odd-even passes of pairwise questions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semframe.functions.text import clip, estimate_py
from semframe.operators.sequence import with_position
from semframe.plans.judge import Ask, Judge, cleaned
from semframe.session import durable

# The seed's levels, its sample of the list, and the passes made by default.
SEED_LEVELS = ("first", "early", "middle", "late", "last")
SAMPLE, SAMPLE_TOKENS, CLIP, PASSES = 80, 12_000, 300, 4
QUIET = 2


def even_sample(df: DataFrame, pos: str, n: int, most: int = SAMPLE, text: str = "text") -> list[str]:
    """At most ``most`` texts spread evenly over ``n`` records, clipped, as many of them as fit the tokens of a sample."""
    step = max(1, n // most)
    rows = df.where(F.pmod(F.col(pos), F.lit(step)) == 0).orderBy(pos).limit(most).select(clip(F.col(text), CLIP).alias("t")).collect()
    out, used = [], 0
    for r in rows:
        used += estimate_py(r["t"])
        if used > SAMPLE_TOKENS:
            break
        out.append(r["t"])
    return out


def sem_sort(df: DataFrame, judge: Judge, order: str, *, passes: int = PASSES, reverse: bool = False, limit: int | None = None,
             ties: Sequence[str | Column] = ("file_idx", "num"), text: str = "text") -> DataFrame:
    """Records with ``pos`` (0-based place in the order) and ``seed``.

    Pass k compares the neighbours at places (i, i+1), i = k mod 2, +2, …, both ways round, and swaps them if
    ``(P(a first) + 1 - P(b first)) / 2 < 0.5``; two passes in a row without a swap end the sort.  A failed comparison raises.
    """
    listed = with_position(df.withColumn("_text", F.coalesce(cleaned(df, text), F.lit(""))), list(ties), "_in")
    n = listed.count()
    sample = {"order": order, "sample": "\n".join(even_sample(listed, "_in", n, text="_text"))} if n else {}
    seed = Ask("score", "Where in the order does `text` belong?", {"text": F.col("_text")}, levels=SEED_LEVELS, context=sample)
    seeded = judge.attach(listed, seed, "_answer")
    seeded = seeded.withColumn("seed", F.col("_answer.score")).withColumn("_error", F.col("_answer.error")).drop("_answer")
    now = durable(with_position(seeded, [F.col("seed").asc_nulls_last(), F.col("_in")], "pos"))
    _stop_on_error(now, "_error")
    now = now.drop("_error")
    quiet = 0
    for k in range(passes):
        par = k % 2
        if n < 2 + par:
            continue
        where = F.floor((F.col("pos") - par) / 2)
        left = now.where((F.col("pos") >= par) & (F.pmod(F.col("pos") - par, F.lit(2)) == 0)).select(where.alias("_pair"), F.col("_text").alias("_a"))
        right = now.where((F.col("pos") >= par) & (F.pmod(F.col("pos") - par, F.lit(2)) == 1)).select(where.alias("_pair"), F.col("_text").alias("_b"))
        pairs = left.join(right, "_pair")
        one = judge.attach(pairs, Ask("noul", "Does `a` come before `b` in the order?", {"a": F.col("_a"), "b": F.col("_b")}, context={"order": order}), "_ab")
        two = judge.attach(one, Ask("noul", "Does `a` come before `b` in the order?", {"a": F.col("_b"), "b": F.col("_a")}, context={"order": order}), "_ba")
        swap = ((F.col("_ab.noul") + (1 - F.col("_ba.noul"))) / 2 < 0.5)
        moved = durable(two.select("_pair", swap.alias("_swap"), F.coalesce("_ab.error", "_ba.error").alias("_error")))
        _stop_on_error(moved, "_error")
        if moved.where("_swap").isEmpty():
            quiet += 1
            if quiet >= QUIET:
                break
            continue
        quiet = 0
        swaps = moved.where("_swap").select("_pair", F.lit(1).alias("_s"))
        side = F.when(F.col("_s").isNull() | (F.col("pos") < par), 0).when(F.pmod(F.col("pos") - par, F.lit(2)) == 0, 1).otherwise(-1)
        now = durable(now.withColumn("_pair", where).join(swaps, "_pair", "left").withColumn("pos", F.col("pos") + side).drop("_pair", "_s"))
    out = now.drop("_in", "_text")
    out = out.orderBy(F.col("pos").desc() if reverse else F.col("pos"))
    return out if limit is None else out.limit(limit)


def _stop_on_error(df: DataFrame, col: str) -> None:
    bad = df.where(F.col(col).isNotNull()).limit(1).collect()
    if bad:
        raise RuntimeError(f"a comparison failed: {bad[0][col]}")
