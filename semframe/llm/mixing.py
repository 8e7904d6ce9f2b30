"""Mixing sources to target weights.

Method: *hash-threshold histograms*.  Every document has a fixed hash; a source's budget is met by all documents below a
threshold.  Tokens are summed by source and hash bucket in one shuffle, a prefix sum finds the bucket in which the budget ends,
and only that bucket is summed again by the next bits of the hash.  From the threshold on, documents are taken in order of
their hash, each if it still fits, until the budget is met to one in a thousand or no document is left; so a few very long
documents do not spoil a small share.  The mix is then a filter on hash ranges: nothing is sorted or ranked.

A source is used ``q`` whole times plus the documents of its hash ranges once more, so no document exceeds ``max_repeats``.
Without a ``budget`` the mix is the largest that keeps all shares exact.

Scale: the full table is read to write the token counts, to sum the buckets, to fetch the documents at the thresholds, and for
the result.  Sources and targets stay in tables of one row per source; the driver gets one number.

Defined cases
-------------
* null and empty texts have no tokens and are not used; a null source, or one without a target, is not used (0);
* a target whose source has no tokens gets share 0, the others keep their proportions;
* a target that is null or not positive, or allows no repeats, is not used; of targets of one source the largest counts;
* repeated documents count as documents of their own; rows with the same id share their fate;
* an empty table gives no uses and shares of 0.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semframe.llm.tokens import VOCAB_DIR, token_count
from semframe.session import durable

#: Bits of the hash that one level of buckets resolves, and bits of the hash in all.
LEVEL_BITS, HASH_BITS = 12, 60
#: A source's budget is met to this share.
CLOSE_ENOUGH = 0.001
#: Buckets beyond the one in which a budget ends are fetched until they hold so many documents; if these do not meet the
#: budget, the next ones are fetched, so this changes the number of rounds and never the result.
FETCHED = 1024
RANGES = "array<struct<a:bigint,z:bigint>>"


def hash60(key: Column, seed: int = 0) -> Column:
    """A non-negative 60-bit hash of the key."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 64 - HASH_BITS)


def sizes_of(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", folder: str = VOCAB_DIR) -> DataFrame:
    """``key, source, n_tokens, h`` of every document, written once to shared storage: each later pass reads only this."""
    return durable(
        docs.select(F.col(key).alias("key"), F.col(source).alias("source"), token_count(F.col(text), folder=folder).alias("n_tokens"))
        .withColumn("h", hash60(F.col("key")))
    )


def _region(docs: DataFrame, live: DataFrame, shift: int, bins: DataFrame | None = None) -> DataFrame:
    """Per source of ``live(source, need, start)``: ``lo, hi, below``: the hash range of the bucket in which ``need`` ends, with as
    many further buckets as hold ``FETCHED`` documents, and the tokens before it.  ``lo`` is null where all documents fit."""
    if bins is None:
        bins = docs.groupBy("source", F.shiftright("h", shift).alias("bin")).agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    per_source = Window.partitionBy("source").orderBy("bin")  # rows are buckets, at most as many as the level has
    upto = bins.join(live, "source").withColumn("upto", F.sum("t").over(per_source))
    over = upto.withColumn("_from", F.when(F.col("upto") > F.col("need"), F.col("n")).otherwise(0)).withColumn("seen", F.sum("_from").over(per_source) - F.col("_from"))
    inside = (F.col("upto") > F.col("need")) & (F.col("seen") < FETCHED)
    return over.groupBy("source").agg(
        F.shiftleft(F.min(F.when(inside, F.col("bin"))), shift).alias("lo"),
        F.shiftleft(F.max(F.when(inside, F.col("bin"))) + 1, shift).alias("hi"),
        F.coalesce(F.min(F.when(inside, F.col("upto") - F.col("t"))), F.max("upto")).alias("below"),
    )


def _greedy(close: float):
    """Documents in order of their hash, each taken if it still fits: ``(source, ranges, need)`` left."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("h", kind="stable")
        left, tolerance = float(rows["left"].iloc[0]), float(rows["goal"].iloc[0]) * close
        ranges: list[list[int]] = []
        # rows with the same hash share their fate
        hs, ts = rows["h"].to_numpy(), rows["n_tokens"].to_numpy()
        i = 0
        while i < len(hs) and left > tolerance:
            j, t = i, 0
            while j < len(hs) and hs[j] == hs[i]:
                t += int(ts[j])
                j += 1
            if t <= left + tolerance:
                left -= t
                # no document lies between two neighbours, so their ranges are one
                if ranges and ranges[-1][2] == i:
                    ranges[-1][1:] = [int(hs[i]) + 1, j]
                else:
                    ranges.append([int(hs[i]), int(hs[i]) + 1, j])
            i = j
        return pd.DataFrame({"source": [key[0]], "more": [[{"a": a, "z": z} for a, z, _ in ranges]], "left": [left]})

    return run


def plan_mix(sizes: DataFrame, targets: DataFrame, budget: float | None = None) -> DataFrame:
    """``source, whole, ranges`` of each target: whole uses, and the hash ranges used once more; ``sizes`` as from ``sizes_of``."""
    good = (
        targets.where("source is not null and target_share > 0 and max_repeats > 0")
        .groupBy("source").agg(F.max(F.struct(F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("bigint").alias("reps"))).alias("m"))
        .select("source", "m.*")
    )
    docs = sizes.where("n_tokens > 0 and source is not null").select("source", "h", F.col("n_tokens").cast("bigint").alias("n_tokens"))
    shift = HASH_BITS - LEVEL_BITS
    bins = durable(docs.groupBy("source", F.shiftright("h", shift).alias("bin")).agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n")))
    live = good.join(bins.groupBy("source").agg(F.sum("t").alias("total")), "source")
    most = live.agg(F.min(F.col("reps") * F.col("total") / F.col("share")).alias("m")).collect()[0]["m"] or 0.0  # one number
    want = F.lit(most if budget is None else min(float(budget), most)) * F.col("share")
    rest = F.col("want") - F.col("whole") * F.col("total")
    now = durable(
        live.withColumn("want", want).withColumn("whole", F.least("reps", F.floor(F.col("want") / F.col("total") + 1e-9)))
        .withColumn("need", F.when((F.col("whole") < F.col("reps")) & (rest > 0.5), rest).otherwise(0.0))
        .select("source", "whole", "need", F.col("need").alias("goal"), F.lit(0).cast("bigint").alias("start"), F.array().cast(RANGES).alias("ranges"))
    )
    while True:
        live = now.where(F.col("need") > F.col("goal") * CLOSE_ENOUGH).select("source", "need", "goal", "start")
        if live.isEmpty():
            return now.select("source", "whole", "ranges")
        ahead = docs.join(live, "source").where(F.col("h") >= F.col("start")).select("source", "h", "n_tokens")
        first = durable(_region(ahead, live, shift, bins))
        bins = None  # of later rounds: only documents from where the last one ended
        # the documents of the boundary buckets, and within them the next bits
        inside = durable(docs.join(first.where("lo is not null"), "source").join(live.select("source", "start"), "source").where("h >= lo and h < hi and h >= start").select("source", "h", "n_tokens"))
        left = live.join(first.select("source", "below"), "source").select("source", (F.col("need") - F.col("below")).alias("need"), "goal", "start")
        fine = _region(inside, left, shift - LEVEL_BITS).withColumnRenamed("below", "more_below")
        at = left.join(fine.select("source", F.col("lo").alias("from"), F.col("hi").alias("to"), "more_below"), "source")
        chosen = (
            inside.join(at, "source").where(F.col("h").between(F.col("from"), F.col("to") - 1))
            .select("source", "h", "n_tokens", (F.col("need") - F.col("more_below")).alias("left"), "goal")
            .groupBy("source").applyInPandas(_greedy(CLOSE_ENOUGH), f"source string, more {RANGES}, left double")  # documents at one threshold
        )
        ends = first.join(at.select("source", "from", "to"), "source", "left").join(chosen, "source", "left")
        big = F.lit(1 << HASH_BITS)
        below = F.struct(F.col("start").alias("a"), F.coalesce("from", big).alias("z"))
        now = durable(
            now.join(ends, "source", "left").select(
                "source", "whole", "goal",
                F.when(F.col("below").isNull(), F.col("ranges")).otherwise(F.concat("ranges", F.array(below), F.coalesce("more", F.array().cast(RANGES)))).alias("ranges"),
                # no source is asked for more documents than it has
                F.when(F.col("below").isNull(), 0.0).when(F.col("from").isNull(), 0.0).otherwise(F.col("left")).alias("need"),
                F.coalesce("to", F.col("start")).alias("start"),
            )
        )


def mix(sizes: DataFrame, targets: DataFrame, budget: float | None = None) -> DataFrame:
    """``key, source, n_tokens, uses`` of every document: one join with a row per source, and no sort."""
    plan = plan_mix(sizes, targets, budget)
    once_more = F.when(F.exists("ranges", lambda r: (F.col("h") >= r["a"]) & (F.col("h") < r["z"])), 1).otherwise(0)
    uses = F.when((F.col("n_tokens") > 0) & F.col("whole").isNotNull(), F.col("whole") + once_more).otherwise(0)
    return sizes.join(plan, "source", "left").select("key", "source", "n_tokens", uses.cast("int").alias("uses"))


def shares(uses: DataFrame, targets: DataFrame) -> DataFrame:
    """What each target really got: ``source, target_share, max_repeats, docs, tokens, actual_share``."""
    got = uses.where(F.col("uses") > 0).groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count(F.lit(1)).alias("docs"), F.max("uses").alias("most_uses")
    )
    total = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # one row per target
    return (
        targets.select("source", F.col("target_share").cast("double").alias("target_share"), "max_repeats")
        .join(got, "source", "left")
        .select(
            "source", "target_share", "max_repeats",
            F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
        )
        .withColumn("actual_share", F.coalesce(F.col("tokens") / F.nullif(total, F.lit(0)), F.lit(0.0)))
    )
