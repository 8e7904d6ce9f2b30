"""The spend ledger: a small table of day, tool, usd and tokens; reports over it."""

from __future__ import annotations

import datetime as dt
import os
import tempfile
import time
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "day date, tool string, usd double, tokens bigint"
HEADER = "# day\ttool\tusd\ttokens\n"
#: Days that an entry stays.
RETENTION = 62


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a ledger file, malformed lines left out."""
    raw = spark.read.text(path, lineSep="\n").where(~F.col("value").startswith("#"))
    f = F.split("value", "\t", -1)
    rows = raw.select(
        F.try_to_date(f[0], "yyyy-MM-dd").alias("day"), F.get(f, 1).alias("tool"), F.get(f, 2).try_cast("double").alias("usd"), F.get(f, 3).try_cast("bigint").alias("tokens"), F.size(f).alias("n"),
    )
    return rows.where("n = 4 and day is not null and usd is not null and tokens is not null").drop("n")


@contextmanager
def _locked(path: str, stale: float = 30.0, wait: float = 10.0):
    lock, end = path + ".lock", time.time() + wait
    while True:
        try:
            fd = os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            break
        except FileExistsError:
            try:
                if time.time() - os.path.getmtime(lock) > stale:
                    os.unlink(lock)
                    continue
            except FileNotFoundError:
                continue
            if time.time() > end:
                raise TimeoutError(f"{lock} is held") from None
            time.sleep(0.02)
    try:
        yield
    finally:
        os.close(fd)
        os.unlink(lock)


def add_spend(path: str, tool: str, usd: float, tokens: int, day: dt.date | None = None) -> None:
    """Add to the day's entry of a tool under a lock; entries older than the retention go; the file is replaced whole."""
    day = day or dt.date.today()
    with _locked(path):
        entries: dict[tuple[str, str], tuple[float, int]] = {}
        if os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                for line in f:
                    part = line.rstrip("\n").split("\t")
                    if line.startswith("#") or len(part) != 4:
                        continue
                    try:
                        entries[part[0], part[1]] = float(part[2]), int(part[3])
                    except ValueError:
                        continue
        u, t = entries.get((day.isoformat(), tool), (0.0, 0))
        entries[day.isoformat(), tool] = u + usd, t + tokens
        oldest = (day - dt.timedelta(days=RETENTION)).isoformat()
        fd, tmp = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)))
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(HEADER)
            for (d, name), (u, t) in sorted(entries.items()):
                if d >= oldest:
                    f.write(f"{d}\t{name}\t{u:.6f}\t{t}\n")
        os.replace(tmp, path)


def merged(old: DataFrame, new: DataFrame, today: dt.date | None = None) -> DataFrame:
    """Two ledgers as one: summed by day and tool, entries beyond the retention left out."""
    out = old.unionByName(new).groupBy("day", "tool").agg(F.sum("usd").alias("usd"), F.sum("tokens").alias("tokens"))
    return out if today is None else out.where(F.col("day") >= F.lit(today - dt.timedelta(days=RETENTION)))


def spend_by_day(ledger: DataFrame, last: dt.date, days: int) -> DataFrame:
    """``day, usd`` of the last days, days without spend as 0."""
    spine = ledger.sparkSession.range(days).select(F.date_sub(F.lit(last), F.col("id").cast("int")).alias("day"))
    spent = ledger.groupBy("day").agg(F.sum(F.col("usd").cast("decimal(24,6)")).alias("usd"))
    return spine.join(spent, "day", "left").select("day", F.coalesce(F.col("usd").cast("double"), F.lit(0.0)).alias("usd"))


def spend_by_tool(ledger: DataFrame, month: str) -> DataFrame:
    """``tool, usd, tokens`` of a month (``YYYY-MM``), the most expensive first."""
    rows = ledger.where(F.date_format("day", "yyyy-MM") == month)
    out = rows.groupBy("tool").agg(F.sum(F.col("usd").cast("decimal(24,6)")).alias("usd"), F.sum("tokens").alias("tokens"))
    return out.select("tool", F.col("usd").cast("double").alias("usd"), "tokens").orderBy(F.col("usd").desc(), "tool")


def spent(ledger: DataFrame, today: dt.date) -> DataFrame:
    """One row: ``today`` and ``month`` spend."""
    usd = F.col("usd").cast("decimal(24,6)")
    return ledger.agg(
        F.coalesce(F.sum(F.when(F.col("day") == F.lit(today), usd)).cast("double"), F.lit(0.0)).alias("today"),
        F.coalesce(F.sum(F.when(F.date_format("day", "yyyy-MM") == today.strftime("%Y-%m"), usd)).cast("double"), F.lit(0.0)).alias("month"),
    )
