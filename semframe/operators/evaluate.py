"""How well probabilities agree with labels: accuracy at a threshold, the best threshold, AUC, class means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The grid of thresholds tried beside 0.5.
GRID = tuple(round(0.05 * k, 2) for k in range(1, 20))


def evaluate(df: DataFrame, p: str = "p", label: str = "label", group: Sequence[str] = ()) -> DataFrame:
    """One row per group: ``n, positives, accuracy`` at 0.5, ``best_threshold, best_accuracy`` (the first strict improvement
    over 0.5 on the grid that is the best), ``auc`` (ties count half; null with one class), ``mean_pos, mean_neg``.

    Rows with a null probability or label are left out.  AUC comes from rank sums over the distinct probabilities, so no pairs
    are formed; all counts are aggregated by distinct probability first.
    """
    key = list(group) or ["_all"]
    base = df if group else df.withColumn("_all", F.lit(0))
    counts = (
        base.where(F.col(p).isNotNull() & F.col(label).isNotNull())
        .groupBy(*key, F.col(p).cast("double").alias("p"))
        .agg(F.count_if(F.col(label).cast("int") == 1).alias("pos"), F.count_if(F.col(label).cast("int") != 1).alias("neg"))
    )
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(*key).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = counts.withColumn("won", F.col("pos") * (below + F.col("neg") / 2))
    right = {t: F.sum(F.when(F.col("p") >= t, F.col("pos")).otherwise(F.col("neg"))) for t in (0.5, *GRID)}
    n = F.sum(F.col("pos") + F.col("neg"))
    agg = ranked.groupBy(*key).agg(
        n.alias("n"), F.sum("pos").alias("positives"), F.sum("neg").alias("_neg"), F.sum("won").alias("_won"),
        F.sum(F.col("p") * F.col("pos")).alias("_sp"), F.sum(F.col("p") * F.col("neg")).alias("_sn"),
        right[0.5].alias("_at"), F.array(*[right[t] for t in GRID]).alias("_grid"),
    )
    top = F.array_max("_grid")
    better = top > F.col("_at")
    at = F.get(F.array(*[F.lit(t) for t in GRID]), (F.array_position("_grid", top) - 1).cast("int"))
    out = agg.select(
        *group, "n", "positives", (F.col("_at") / F.col("n")).alias("accuracy"),
        F.when(better, at).otherwise(0.5).alias("best_threshold"), (F.when(better, top).otherwise(F.col("_at")) / F.col("n")).alias("best_accuracy"),
        F.when((F.col("positives") > 0) & (F.col("_neg") > 0), F.col("_won") / (F.col("positives") * F.col("_neg"))).alias("auc"),
        (F.col("_sp") / F.greatest("positives", F.lit(1))).alias("mean_pos"), (F.col("_sn") / F.greatest("_neg", F.lit(1))).alias("mean_neg"),
    )
    return out
