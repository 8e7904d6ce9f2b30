"""Rolling totals over trailing calendar periods, days without activity included.

Method: entries are pre-aggregated to one row per entity and day (map-side combine, so a hot entity costs one row per
day), shuffled once by entity, sorted inside the partitions, and a *two-stack monoid queue* per window slides over the
days.  The queue only ever combines, never subtracts, so maxima work as well as sums.

Defined cases
-------------
* entries written twice (same ``entry_id``) count once, the earliest ``recorded_at`` is kept; entries with a null id
  are all kept;
* a null value adds nothing; a day whose values are all null has total 0; null days are dropped; a null entity is an
  entity of its own;
* the window of ``d`` and ``w`` days is ``d-w+1 .. d``; the average divides by the days of the window that lie in the
  entity's period, as a window function over its calendar would.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MICRO = 1_000_000


class MonoidQueue:
    """First-in first-out window with the combination of all its elements at hand in amortised O(1).

    ``back`` collects arrivals with one running value; when ``front`` runs dry, the back is turned over into suffix
    combinations.  Needs only associativity of ``combine``, no inverse.
    """

    def __init__(self, combine: Callable, identity) -> None:
        self.combine, self.identity = combine, identity
        self.front: list = []
        self.back: list = []
        self.back_total = identity

    def push(self, value) -> None:
        self.back.append(value)
        self.back_total = self.combine(self.back_total, value)

    def pop(self) -> None:
        if not self.front:
            total = self.identity
            while self.back:
                total = self.combine(self.back.pop(), total)
                self.front.append(total)
            self.back_total = self.identity
        self.front.pop()

    def total(self):
        return self.combine(self.front[-1], self.back_total) if self.front else self.back_total

    def __len__(self) -> int:
        return len(self.front) + len(self.back)


def _add_and_max(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], a[1] + b[1], a[2] if a[2] >= b[2] else b[2]


_IDENTITY = (0, 0, -(2**63))


def daily_totals(ledger: DataFrame, entity: str = "tool", day: str = "day", cost: str = "usd", tokens: str = "tokens") -> DataFrame:
    """One row per entity and day with activity: ``entity, day, micros, tokens, entries``; entries counted once."""
    rows = ledger.select(
        F.col("entry_id"),
        F.col(entity).alias("entity"),
        F.col(day).cast("date").alias("day"),
        F.col(cost).try_cast("decimal(24,6)").alias("cost"),
        F.col(tokens).cast("bigint").alias("tokens"),
        "recorded_at",
    ).where(F.col("day").isNotNull())
    once = (
        rows.where(F.col("entry_id").isNotNull())
        .groupBy("entry_id")
        .agg(F.min(F.struct("recorded_at", "entity", "day", "cost", "tokens")).alias("r"))
        .select("r.entity", "r.day", "r.cost", "r.tokens")
    )
    kept = once.unionByName(rows.where(F.col("entry_id").isNull()).select("entity", "day", "cost", "tokens"))
    return kept.groupBy("entity", "day").agg(
        F.coalesce((F.sum("cost") * MICRO).cast("bigint"), F.lit(0)).alias("micros"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.count(F.lit(1)).alias("entries"),
    )


def rolling_totals(ledger: DataFrame, windows: tuple[int, ...] = (7, 30), entity: str = "tool", day: str = "day",
                   cost: str = "usd", tokens: str = "tokens") -> DataFrame:
    """Per entity and calendar day between its first and last day: totals, daily averages and the largest daily cost.

    Columns: the entity, ``day``, ``usd``, ``tokens`` of the day, and per window ``w``: ``usd_w, tokens_w, avg_usd_w,
    avg_tokens_w, max_usd_w``.
    """
    daily = daily_totals(ledger, entity, day, cost, tokens)
    placed = daily.select("entity", "day", "micros", "tokens").repartition("entity").sortWithinPartitions("entity", "day")
    kind = dict(daily.dtypes)["entity"]
    per_window = ", ".join(
        f"usd_{w} double, tokens_{w} bigint, avg_usd_{w} double, avg_tokens_{w} double, max_usd_{w} double" for w in windows
    )
    names = ["entity", "day", "usd", "tokens"] + [
        f"{n}_{w}" for w in windows for n in ("usd", "tokens", "avg_usd", "avg_tokens", "max_usd")
    ]

    def slide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        started, current, last = False, None, None
        queues: list[tuple[int, MonoidQueue]] = []
        step = dt.timedelta(days=1)

        def emit(out: list, ent, d: dt.date, micros: int, toks: int) -> None:
            row = [ent, d, micros / MICRO, toks]
            for w, q in queues:
                q.push((micros, toks, micros))
                if len(q) > w:
                    q.pop()
                m, t, top = q.total()
                n = len(q)
                row += [m / MICRO, t, m / MICRO / n, t / n, top / MICRO]
            out.append(row)

        for batch in batches:
            out: list = []
            for ent, d, micros, toks in zip(batch["entity"], batch["day"], batch["micros"], batch["tokens"]):
                ent = None if pd.isna(ent) else ent
                if not started or ent != current:
                    started, current, last = True, ent, None
                    queues = [(w, MonoidQueue(_add_and_max, _IDENTITY)) for w in windows]
                while last is not None and last + step < d:
                    last += step
                    emit(out, ent, last, 0, 0)
                emit(out, ent, d, int(micros), int(toks))
                last = d
                if len(out) >= 20_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            if out:
                yield pd.DataFrame(out, columns=names)

    done = placed.mapInPandas(slide, f"entity {kind}, day date, usd double, tokens bigint, {per_window}")
    return done.withColumnRenamed("entity", entity)
