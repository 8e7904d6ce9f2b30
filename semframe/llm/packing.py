"""Putting items of varying length into requests of fixed capacity.

Method: *non-negative least squares over shallow combinations*.  A state's items are reduced to a histogram of lengths,
which is bounded by the capacity, not by the number of items.  Combinations of at most three lengths that fill the
request to within a small window become the columns of a matrix; non-negative least squares finds how often each should
be repeated to reproduce the histogram; the counts are rounded within what is there, and the rest is packed greedily,
longest first into the fullest request that still has room.

The combinations are shallow: of all that fill the window (billions for a state of 1,600 lengths) those with ``MULTIPLES``
of their longest length and the ``PARTNERS`` best-fitting lengths beside it are enumerated.  This bounds the matrix, not the
result: whatever the chosen columns leave over is packed greedily, so every item is placed, and of the ``ROUNDINGS`` the one
that needs the fewest requests is kept, stopping at the least number that any packing could need.

The solution names, for every length, ranges of ranks and the requests they go to.  Items find their request by their
rank among the items of their state and length.  Ranks are counted in salted parts with prefix sums, so neither a state
nor a length with a third of all rows is ever in one task.

Defined cases
-------------
* rows that repeat an ``item_id`` are one item (the least row counts);
* an item larger than the capacity is cut into parts of the full capacity and one rest, which is packed like an item;
  no other item is split;
* a null or negative ``est`` is an unknown size: a request of its own, ``status = unknown_size``, est null;
* no room (null state, null ``state_est``, unknown protocol, or a state as large as the request): a request of its own,
  ``status = no_room``;
* an ``est`` of 0 takes no space and is packed like any other.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Parts in which the items of one state and length are ranked.
SALTS = 16
#: Ranks in a block, by which ranges of ranks are joined.
BLOCK = 64
#: A combination may leave this share of the request unused.
WINDOW = 0.02
#: Rounds of the least squares over all columns at once.
SWEEPS = 60
#: How often a combination may hold its longest length: so many times, and half and all of what fits.
MULTIPLES = (1, 2)
#: Best-fitting second lengths, second lengths of half the room, and third lengths that are tried.
PARTNERS = (3, 1, 2)


# --- the solver: a histogram in, rank ranges out -------------------------------------------------------------------
def _columns(lens: list[int], counts: list[int], cap: int) -> list[tuple[tuple[int, int], ...]]:
    """Combinations of at most three lengths, each as ``((index, how often), ...)``; ``lens`` ascending, above 0."""
    slack = int(cap * WINDOW)
    out: dict[tuple[tuple[int, int], ...], None] = {}

    def fit(room: int, ban: tuple[int, ...], tries: int) -> list[int]:
        k, found = bisect_right(lens, room) - 1, []
        while k >= 0 and len(found) < tries:
            if k not in ban:
                found.append(k)
            k -= 1
        return found

    for a in range(len(lens) - 1, -1, -1):
        most = min(cap // lens[a], counts[a])
        for ka in sorted({*MULTIPLES, most // 2, most} - {0}):
            if ka > most:
                continue
            room = cap - ka * lens[a]
            if room <= slack:
                out[((a, ka),)] = None
                continue
            for b in fit(room, (a,), PARTNERS[0]) + fit(room // 2, (a,), PARTNERS[1]):
                kb = min(room // lens[b], counts[b])
                for k in {1, kb}:
                    left = room - k * lens[b]
                    if left <= slack:
                        out[tuple(sorted(((a, ka), (b, k))))] = None
                        continue
                    for c in fit(left, (a, b), PARTNERS[2]):
                        kc = min(left // lens[c], counts[c])
                        if left - kc * lens[c] <= slack:
                            out[tuple(sorted(((a, ka), (b, k), (c, kc))))] = None
    return list(out)


def nnls(columns: list[tuple[tuple[int, int], ...]], target: list[int], sweeps: int = SWEEPS) -> list[float]:
    """Repeat counts ``x >= 0`` minimising ``|A x - target|``: projected gradients with momentum over all columns at once.  The
    step of a column is the inverse of the row sums it touches, which majorises the matrix, so the steps never overshoot."""
    if not columns:
        return []
    index = np.zeros((len(columns), 3), dtype=np.int64)
    times = np.zeros((len(columns), 3))
    for j, col in enumerate(columns):
        for k, (i, m) in enumerate(col):
            index[j, k], times[j, k] = i, m
    goal, flat = np.asarray(target, dtype=float), index.ravel()
    rows = np.bincount(flat, weights=times.ravel(), minlength=len(goal))
    step = 1 / (times * rows[index]).sum(axis=1)
    x = y = np.zeros(len(columns))
    t = 1.0
    for _ in range(sweeps):
        rest = goal - np.bincount(flat, weights=(times * y[:, None]).ravel(), minlength=len(goal))
        new = np.maximum(0.0, y + step * (times * rest[index]).sum(axis=1))
        t, last = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        y = new + (last - 1) / t * (new - x)
        moved, x = np.abs(new - x).max(), new
        if moved < 1e-3:
            break
    return x.tolist()


#: A combination is used if its count is at least this much; the rounding that needs the fewest requests is kept.  The last
#: two use little of the solution; of the 666 states of sf0.1 they won none, 650 ended with the first.
ROUNDINGS = (0.5, 0.25, 0.75, 1.0, 1.5, 3.0, 8.0)


def _rounded(lens: list[int], counts: list[int], cap: int, cols: list, x: list[float], least: float) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """Requests and rank ranges for one way of rounding; ``lens`` ascending.  What is left is packed greedily: longest first,
    into the request with the least sufficient room."""
    left, used, rows, bins = list(counts), [0] * len(lens), [], 0

    def place(i: int, first_bin: int, times: int, per: int) -> None:
        rows.append((lens[i], used[i], times * per, first_bin, per))
        used[i] += times * per
        left[i] -= times * per

    if lens and lens[-1] == cap and left[-1]:  # these fill a request by themselves
        n = left[-1]
        place(len(lens) - 1, bins, n, 1)
        bins += n
    for j in sorted(range(len(cols)), key=lambda j: (-x[j], j)):
        if x[j] < least:
            break
        times = min(max(1, int(x[j] + 0.5) if least < 1 else int(x[j])), min(left[i] // m for i, m in cols[j]))
        if times > 0:
            for i, m in cols[j]:
                place(i, bins, times, m)
            bins += times
    rooms: list[tuple[int, int]] = []
    for i in range(len(lens) - 1, -1, -1):
        while left[i] > 0:
            at = bisect_left(rooms, (lens[i], -1))
            if at == len(rooms):
                # as many new requests as whole fillings, at once
                per = max(1, min(left[i], cap // lens[i] if lens[i] else left[i]))
                times = left[i] // per
                for k in range(times):
                    insort(rooms, (cap - per * lens[i], bins + k))
                place(i, bins, times, per)
                bins += times
            else:
                room, b = rooms.pop(at)
                per = min(left[i], room // lens[i] if lens[i] else left[i])
                place(i, b, 1, per)
                insort(rooms, (room - per * lens[i], b))
    return bins, rows


def pack_histogram(lens: list[int], counts: list[int], cap: int) -> list[tuple[int, int, int, int, int]]:
    """``(len, first rank, how many, first bin, per bin)``: ranks ``first + i`` of a length go to bin ``first bin + i // per bin``.

    Every rank of every length is covered exactly once and no bin exceeds ``cap``.
    """
    order = sorted(range(len(lens)), key=lambda i: lens[i])
    lens, counts = [int(lens[i]) for i in order], [int(counts[i]) for i in order]
    index = [i for i in range(len(lens)) if 0 < lens[i] < cap and counts[i] > 0]
    cols = _columns([lens[i] for i in index], [counts[i] for i in index], cap) if index else []
    x = nnls(cols, [counts[i] for i in index])
    cols = [tuple((index[i], m) for i, m in c) for c in cols]
    # no packing needs fewer: by the sum of the lengths, and as no two of more than half the room fit together
    bound = max(-(-sum(a * n for a, n in zip(lens, counts)) // cap), sum(n for a, n in zip(lens, counts) if 2 * a > cap))
    best: tuple | None = None
    for least in ROUNDINGS:
        made = _rounded(lens, counts, cap, cols, x, least)
        if best is None or made[0] < best[0]:
            best = made
        if best[0] <= bound:
            break
    return best[1]


# --- Spark -----------------------------------------------------------------------------------------------------------
def pieces_of(items: DataFrame, limits: DataFrame) -> DataFrame:
    """Items once each, oversized ones cut: ``item_id, part, parts, state_id, protocol, state_est, ctx_total, cap, len, status``."""
    once = (
        items.groupBy("item_id")
        .agg(F.min(F.struct("state_id", "protocol", "state_est", "est")).alias("r"))
        .select("item_id", "r.*")
    )
    caps = F.broadcast(limits.select(F.col("protocol"), F.col("ctx_total").cast("bigint").alias("ctx_total")))  # one row per protocol, three in all
    cap = F.col("ctx_total") - F.col("state_est")
    sized = (
        once.join(caps, "protocol", "left")
        .withColumn("cap", cap.cast("bigint"))
        .withColumn(
            "status",
            F.when(F.col("state_id").isNull() | F.coalesce(F.col("cap") <= 0, F.lit(True)), "no_room")
            .when(F.col("est").isNull() | (F.col("est") < 0), "unknown_size")
            .otherwise("packed"),
        )
    )
    parts = F.when((F.col("status") == "packed") & (F.col("est") > F.col("cap")), F.ceil(F.col("est") / F.col("cap"))).otherwise(1).cast("int")
    cut = sized.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(1), F.col("parts"))))
    length = (
        F.when(F.col("parts") == 1, F.when(F.col("est") >= 0, F.col("est")))
        .when(F.col("part") < F.col("parts"), F.col("cap"))
        .otherwise(F.col("est") - F.col("cap") * (F.col("parts") - 1))
    )
    return cut.select("item_id", "part", "parts", "state_id", "protocol", "state_est", "ctx_total", "cap", length.cast("bigint").alias("len"), "status")


def _solve(key: tuple, hist: pd.DataFrame) -> pd.DataFrame:
    rows = pack_histogram(hist["len"].tolist(), hist["n"].tolist(), int(hist["cap"].iloc[0]))
    out = pd.DataFrame(rows, columns=["len", "first", "many", "bin", "per"]).astype("int64")
    out.insert(0, "cap", np.int64(hist["cap"].iloc[0]))
    out.insert(0, "state_id", key[0])
    return out


def assign(items: DataFrame, limits: DataFrame) -> DataFrame:
    """``item_id, part, parts, state_id, protocol, request_id, part_est, status`` and the request's frame
    (``state_est, ctx_total``): one row per item, and per part of an oversized one."""
    pieces = pieces_of(items, limits)
    packed = pieces.where(F.col("status") == "packed").withColumn("salt", F.pmod(F.xxhash64("item_id", "part"), F.lit(SALTS)).cast("int"))
    counted = packed.groupBy("state_id", "cap", "len", "salt").agg(F.count(F.lit(1)).alias("n"))
    slots = (
        counted.groupBy("state_id", "cap", "len").agg(F.sum("n").alias("n"))
        .groupBy("state_id", "cap").applyInPandas(_solve, "state_id string, cap bigint, len bigint, first bigint, many bigint, bin bigint, per bigint")
        # a range of ranks by the blocks it touches: items find it by an equi-join, however many ranges a length has
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("first") + F.col("many") - 1) / BLOCK))))
    )
    before = F.sum("n").over(Window.partitionBy("state_id", "cap", "len").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counted.withColumn("offset", F.coalesce(before, F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("state_id", "cap", "len", "salt").orderBy("item_id", "part")) - 1
    placed = (
        packed.withColumn("rank", rank)
        .join(offsets, ["state_id", "cap", "len", "salt"])
        .withColumn("rank", F.col("rank") + F.col("offset")).withColumn("block", F.floor(F.col("rank") / BLOCK))
        .join(slots, ["state_id", "cap", "len", "block"])
        .where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("many")))
        .withColumn("bin", F.expr("bin + (rank - first) div per"))
        .withColumn("request_id", F.concat_ws("/", "state_id", F.col("cap").cast("string"), F.col("bin").cast("string")))
    )
    alone = pieces.where(F.col("status") != "packed").withColumn(
        "request_id", F.concat_ws("/", F.coalesce("state_id", F.lit("")), F.lit("alone"), F.col("item_id").cast("string"))
    )
    names = ["item_id", "part", "parts", "state_id", "protocol", "request_id", "len", "status", "state_est", "ctx_total"]
    return placed.select(names).unionByName(alone.select(names)).withColumnRenamed("len", "part_est")


def requests(assigned: DataFrame) -> DataFrame:
    """``request_id, state_id, protocol, n_parts, est, ctx_total, unused, status``: est counts the state once."""
    return assigned.groupBy("request_id", "state_id", "protocol").agg(
        F.count(F.lit(1)).alias("n_parts"),
        (F.max("state_est") + F.sum("part_est")).alias("est"),
        F.max("ctx_total").alias("ctx_total"),
        F.max("status").alias("status"),
    ).withColumn("unused", F.col("ctx_total") - F.col("est"))


def fill(assigned: DataFrame) -> DataFrame:
    """Per protocol: requests made, the least any packing could need, and the share of the capacity left unused."""
    per_state = (
        assigned.where(F.col("status") == "packed")
        .groupBy("protocol", "state_id", F.col("state_est"), F.col("ctx_total"), "request_id").agg(F.sum("part_est").alias("load"))
        .groupBy("protocol", "state_id", "state_est", "ctx_total").agg(F.count(F.lit(1)).alias("requests"), F.sum("load").alias("load"))
        .withColumn("cap", F.col("ctx_total") - F.col("state_est"))
    )
    return per_state.groupBy("protocol").agg(
        F.sum("requests").alias("requests"),
        F.sum(F.greatest(F.lit(1), F.ceil(F.col("load") / F.col("cap")))).alias("least"),
        (1 - F.sum("load") / F.sum(F.col("cap") * F.col("requests"))).alias("unused_share"),
    )
