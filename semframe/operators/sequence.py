"""Record-order building blocks that never put a whole file into one task.

Record numbers are dense within their group, so neighbours are windows over blocks of numbers whose borders overlap, and a
running sum is a sum within blocks plus the sums of the blocks before.  A file with a third of all rows is spread like any
other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semframe.plans.judge import Ask, ExprJudge, Judge
from semframe.session import durable

#: Records whose running values one task computes.
BLOCK = 1 << 16
_LOCAL_BITS = 33  # of monotonically_increasing_id


def _offsets(placed: DataFrame, n: Column) -> DataFrame:
    """``placed`` with the sum of ``n`` over the partitions before (``_sum_before``); ``_id`` is a monotonically increasing id."""
    placed = placed.withColumn("_part", F.shiftright("_id", _LOCAL_BITS))
    sizes = placed.groupBy("_part").agg(F.sum(n).alias("_n"))  # one row per partition
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(F.broadcast(sizes.withColumn("_sum_before", before).select("_part", "_sum_before")), "_part")


def _placed_keys(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, bool]:
    """``(keys, unique)``: each distinct key with ``_pos``, the 0-based position of its first row in the order ``by``, and
    whether no key has two rows.  Only keys are sorted and written, never the records."""
    keys = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_c")).orderBy(*by).withColumn("_id", F.monotonically_increasing_id())
    keys = durable(keys)
    unique = (keys.agg(F.max("_c").alias("m")).collect()[0]["m"] or 1) == 1
    placed = _offsets(keys, F.col("_c"))
    if unique:
        at = F.col("_id").bitwiseAND((1 << _LOCAL_BITS) - 1)
    else:
        at = F.coalesce(F.sum("_c").over(Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.withColumn("_pos", F.col("_sum_before") + at).drop("_part", "_id", "_c", "_sum_before"), unique


def _join_back(df: DataFrame, keys: DataFrame, by: Sequence[str], unique: bool) -> DataFrame:
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) for c in by]
    extra = [F.col(f"k.{c}") for c in keys.columns if c not in by]
    out = df.alias("r").join(keys.alias("k"), same).select("r.*", *extra)
    if unique:
        return out
    # rows of one key in any order
    return out.withColumn("_pos", F.col("_pos") + F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64(*df.columns))) - 1)


def with_position(df: DataFrame, by: Sequence[Column | str], out: str = "pos") -> DataFrame:
    """``out``: 0-based position in the global order ``by``.

    An order of columns sorts the keys alone and joins the positions back.  Other orders sort the rows, and with an empty ``by``
    they are numbered as they lie, without a shuffle; then the rows themselves are written, as their places must not change.
    """
    if by and all(isinstance(c, str) for c in by):
        keys, unique = _placed_keys(df, by)
        return _join_back(df, keys, by, unique).withColumnRenamed("_pos", out)
    placed = _offsets(durable((df.orderBy(*by) if by else df).withColumn("_id", F.monotonically_increasing_id())), F.lit(1))
    at = F.col("_id").bitwiseAND((1 << _LOCAL_BITS) - 1)
    return placed.withColumn(out, F.col("_sum_before") + at).drop("_part", "_id", "_sum_before")


def numbered(df: DataFrame, group: Sequence[str], by: Sequence[str], out: str = "num") -> DataFrame:
    """``out``: 1-based number within the group in the order ``by``; what is sorted are the keys, not the records."""
    order = list(dict.fromkeys([*group, *by]))
    keys, unique = _placed_keys(df, order)
    first = keys.groupBy(*group).agg(F.min("_pos").alias("_first"))
    same = [F.col(f"p.{g}").eqNullSafe(F.col(f"f.{g}")) for g in group]
    keys = keys.alias("p").join(first.alias("f"), same).select("p.*", "f._first")
    return _join_back(df, keys, order, unique).withColumn(out, F.col("_pos") - F.col("_first") + 1).drop("_pos", "_first")


def over_neighbours(df: DataFrame, cols: dict, reach: int, group: Sequence[str] = ("file_idx",), num: str = "num", block: int = BLOCK) -> DataFrame:
    """``cols``: name to a function from a window to a column that looks at most ``reach`` records back or ahead.

    One shuffle by group and block of numbers: a record within ``reach`` of the border of its block also goes, as a witness, to
    the block beyond, so a window over the block sees all it needs and no group is one task.
    """
    if reach >= block:
        raise ValueError("a record may not look beyond the next block")
    at = F.floor(F.col(num) / block)
    near = F.array_distinct(F.array(F.floor((F.col(num) - reach) / block), at, F.floor((F.col(num) + reach) / block)))
    placed = df.withColumn("_own", at).withColumn("_block", F.explode(near))
    w = Window.partitionBy(*group, "_block").orderBy(num)
    for name, f in cols.items():
        placed = placed.withColumn(name, f(w))
    return placed.where(F.col("_own") == F.col("_block")).drop("_own", "_block")


def with_shifted(df: DataFrame, cols: dict[str, str], offset: int, group: Sequence[str] = ("file_idx",), num: str = "num") -> DataFrame:
    """Columns of the record ``offset`` further on in the group (-1: the one before), null beyond the ends.  Numbers may have
    gaps: a record whose neighbour is missing gets nulls."""
    def value(a: str):
        return lambda w: F.when(F.lead(num, offset).over(w) == F.col(num) + offset, F.lead(a, offset).over(w))

    return over_neighbours(df, {b: value(a) for a, b in cols.items()}, abs(offset), group, num)


def beside_pair(paired: DataFrame, about: dict[str, Column], n: int, group: Sequence[str], text: str = "_text") -> tuple[DataFrame, dict[str, Column]]:
    """What a question about a record and the one before is shown besides: ``n`` records before both and ``n`` after."""
    def some(steps):
        def lists(w):
            found = F.filter(F.array(*[F.lead(text, k).over(w) for k in steps]), lambda x: x.isNotNull())
            return F.when(F.size(found) > 0, found)

        return lists

    shown = over_neighbours(paired, {"_earlier": some(range(-n - 1, -1)), "_later": some(range(1, n + 1))}, n + 1, group)
    return shown, {"before": F.col("_earlier"), **about, "after": F.col("_later")}


def running_sum(df: DataFrame, value: Column, out: str, group: Sequence[str] = ("file_idx",), num: str = "num", block: int = BLOCK) -> DataFrame:
    """``out``: the sum of ``value`` over the group's records up to and with this one."""
    cut = df.withColumn("_v", value).withColumn("_block", F.floor(F.col(num) / block))
    inner = F.sum("_v").over(Window.partitionBy(*group, "_block").orderBy(num).rowsBetween(Window.unboundedPreceding, 0))
    sums = cut.groupBy(*group, "_block").agg(F.sum("_v").alias("_s"))  # one row per block
    before = F.coalesce(F.sum("_s").over(Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.withColumn("_sum_before", before).select(*group, "_block", "_sum_before")
    return cut.withColumn("_inner", inner).join(offsets, [*group, "_block"]).withColumn(out, F.col("_inner") + F.col("_sum_before")).drop("_v", "_block", "_inner", "_sum_before")


def judge_where(df: DataFrame, judge: Judge, ask: Ask, out: str, condition: Column) -> DataFrame:
    """Answers only for rows that meet ``condition``; the others have a null answer and are never asked about."""
    if isinstance(judge, ExprJudge):
        return judge.attach(df, ask, "_asked").withColumn(out, F.when(condition, F.col("_asked"))).drop("_asked")
    asked = judge.attach(df.where(condition), ask, out)
    kind = asked.schema[out].dataType
    return asked.unionByName(df.where(~F.coalesce(condition, F.lit(False))).withColumn(out, F.lit(None).cast(kind)))
