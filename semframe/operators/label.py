"""Labels for records: flat, with thresholds and escapes, and by a taxonomy with beam search."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semframe.functions.templates import Label, TreeNode, check_placeholders, has_placeholder, rewrite_placeholders
from semframe.operators.options import OptionJudge, choose_among
from semframe.plans.judge import Ask, Judge, cleaned
from semframe.session import durable
from semframe.sources.records import with_fields, with_neighbours

UNSURE, BROKEN, OTHER = "?", "!", "other"


def sem_label(df: DataFrame, judge: Judge, labels: Sequence[Label], question: str | None = None, *, other: str | None = None, threshold: float = 0.0,
              unsure: str = UNSURE, only: Sequence[str] | None = None, text: str = "text", delimiter: str | None = None, window: int = 0,
              group: Sequence[str] = ("file_idx",), context: dict[str, str] | None = None) -> DataFrame:
    """Every record with ``label``, ``confidence`` and ``error``.

    A confidence below the threshold (strictly) gives the label ``unsure``, a failed record ``!``; ``other`` is offered as the
    last option; ``only`` keeps records by their final label.
    """
    options = tuple(labels) + ((Label(other),) if other else ())
    if question is None:
        q = "Which option best fits `text`?"
    else:
        check_placeholders(question, delimiter is not None)
        q = rewrite_placeholders(question) if has_placeholder(question) else f"Regarding `text`: {question}"
    about = {}
    if window:
        df = with_neighbours(df, window, group, text=text)
        about["before"] = F.col("before")
    about["text"] = F.coalesce(cleaned(df, text), F.lit(""))
    if delimiter is not None:
        import re

        df = with_fields(df, delimiter, text)
        for n in sorted({int(x) for x in re.findall(r"\{(\d+)\}", question or "")}):
            about[f"f{n}"] = F.coalesce(F.try_element_at(F.col("fields"), F.lit(n)), F.lit(""))
    if window:
        about["after"] = F.col("after")
    out = judge.attach(df, Ask("choice", q, about, options=options, context=context or {}), "_answer")
    out = out.withColumn("confidence", F.col("_answer.confidence")).withColumn("error", F.col("_answer.error"))
    label = (
        F.when(F.col("error").isNotNull(), BROKEN)
        .when(F.col("confidence") < threshold, unsure)
        .otherwise(F.col("_answer.choice"))
    )
    out = out.withColumn("label", label).drop("_answer", *(["before", "after"] if window else []))
    return out if only is None else out.where(F.col("label").isin(list(only)))


def label_counts(labelled: DataFrame, by: Sequence[str] = ("file_idx", "num")) -> DataFrame:
    """``label, n, place``: how many records have each label, in the order in which the labels first appear."""
    n = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*by)).alias("_first"))
    return n.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_first"))).drop("_first")  # one row per label


ROUTE_LEVELS = 8


def route(labelled: DataFrame, path: str, text: str = "text", levels: int = ROUTE_LEVELS) -> None:
    """Append the records to folders below ``path``, one per label: ``/`` in a label nests (``level1=a/level2=b/…``), components
    that are empty or dots become ``_``; failed records are not written.

    The levels are partition columns of one write; of a label with more than ``levels`` components the last ones stay joined.
    """
    named = labelled.where(F.col("label") != BROKEN).select(F.col(text).alias("text"), F.transform(
        F.split("label", "/"), lambda x: F.when(x.isin("", ".", ".."), "_").otherwise(x)).alias("_parts"))
    depth = named.agg(F.max(F.size("_parts")).alias("n")).collect()[0]["n"] or 1  # one number
    cols = [f"level{k}" for k in range(1, min(depth, levels) + 1)]
    for k, c in enumerate(cols, 1):
        last = k == len(cols)
        own = F.array_join(F.slice("_parts", F.lit(k), F.greatest(F.size("_parts") - (k - 1), F.lit(0))), "/") if last else F.get("_parts", k - 1)
        named = named.withColumn(c, F.when(F.size("_parts") >= k, own))
    # records of one depth at a time: a label that ends early has no folder below it
    for k in range(1, len(cols) + 1):
        size = F.size("_parts") == k if k < len(cols) else F.size("_parts") >= k
        named.where(size).select(*cols[:k], "text").write.partitionBy(*cols[:k]).mode("append").text(path)


# --- taxonomy ----------------------------------------------------------------------------------------------------------
def _edges(roots: list[TreeNode]) -> tuple[list[tuple], dict[int, int]]:
    """``(parent, node, name, hint, place, leaf)`` of a taxonomy, root 0; and where a walk from a node really starts, past
    parents with one child."""
    rows: list[tuple] = []
    only: dict[int, int] = {}
    count = 0

    def walk(parent: int, kids: list[TreeNode]) -> None:
        nonlocal count
        for place, k in enumerate(kids):
            count += 1
            me = count
            below = ", ".join(g.name for g in k.children[:20]) + (" …" if len(k.children) > 20 else "")
            hint = "; ".join(x for x in (k.description, below) if x) or None
            rows.append((parent, me, k.name, hint, place, not k.children))
            if len(kids) == 1:
                only[parent] = me
            walk(me, k.children)

    walk(0, roots)
    return rows, only


def sem_label_tree(df: DataFrame, judge: Judge, roots: list[TreeNode], *, key: Sequence[str] = ("file_idx", "num"), beam: int = 3, threshold: float = 0.0,
                   unsure: str = UNSURE, only: Sequence[str] | None = None, text: str = "text") -> DataFrame:
    """Labels by a taxonomy: per level every open path of every record asks for one child; the ``beam`` best paths go on.

    ``label`` is the path of names, ``confidence`` the geometric mean of the probabilities along it; a parent with one child
    costs no question and does not count.  Ties keep option order.

    A judge by expression is asked within the row: the taxonomy is a constant, the open paths of a record are an array in it, so
    nothing is shuffled and no text copied.  With other judges all records advance together, one job per level.
    """
    rows, forced = _edges(roots)
    spark = df.sparkSession
    if isinstance(judge, OptionJudge):
        out = _by_expression(df, judge, rows, forced, beam, text)
        return _final(out, threshold, unsure, only)
    edges = spark.createDataFrame(rows, "parent int, node int, name string, hint string, place int, leaf boolean")
    name = {r[1]: r[2] for r in rows}
    leaf = {0: False} | {r[1]: r[5] for r in rows}

    def down(node: int) -> tuple[int, str]:
        path = ""
        while node in forced:
            node = forced[node]
            path += "/" + name[node]
        return node, path

    steps = spark.createDataFrame([(n, *down(n), leaf[down(n)[0]]) for n in leaf], "at int, to int, more string, ends boolean")
    start, prefix = down(0)
    base = df.select(*key, F.coalesce(cleaned(df, text), F.lit("")).alias("_text"))
    paths = base.select(*key, F.lit(start).alias("at"), F.lit(prefix).alias("path"), F.lit(0.0).alias("logp"), F.lit(0).alias("edges"), F.lit(leaf[start]).alias("done"), F.array(F.lit(0)).alias("rank"))
    depth = 0
    while True:
        live = paths.where("not done")
        if depth and live.isEmpty():
            break
        depth += 1
        asked = live.join(edges, F.col("at") == F.col("parent")).join(base, list(key))
        judged = choose_among(asked, judge, [*key, "at"], "Which option best fits `text`?", text="_text", option="name", hint="hint", place="place")
        grown = (
            judged.where((F.col("p") > 0) & F.col("error").isNull())
            .join(steps.withColumnRenamed("at", "node"), "node")
            .select(*key, F.col("to").alias("at"), F.concat("path", F.lit("/"), "name", "more").alias("path"),
                    (F.col("logp") + F.log(F.greatest("p", F.lit(1e-9)))).alias("logp"), (F.col("edges") + 1).alias("edges"),
                    F.col("ends").alias("done"), F.concat("rank", F.array("place")).alias("rank"))
        )
        score = F.when(F.col("edges") > 0, F.col("logp") / F.col("edges")).otherwise(0.0)
        best = F.row_number().over(Window.partitionBy(*key).orderBy(score.desc(), "rank"))
        paths = durable(paths.where("done").unionByName(grown).withColumn("_r", best).where(F.col("_r") <= beam).drop("_r"))
    score = F.when(F.col("edges") > 0, F.exp(F.col("logp") / F.col("edges"))).otherwise(1.0)
    top = (
        paths.withColumn("confidence", score)
        .groupBy(*key).agg(F.min(F.struct((-F.col("confidence")).alias("c"), "rank", "path")).alias("b"))
        .select(*key, F.substring(F.col("b.path"), F.lit(2), F.length("b.path")).alias("label"), (-F.col("b.c")).alias("confidence"))
    )
    return _final(df.join(top, list(key), "left"), threshold, unsure, only)


def _final(out: DataFrame, threshold: float, unsure: str, only: Sequence[str] | None) -> DataFrame:
    label = F.when(F.col("label").isNull(), BROKEN).when(F.col("confidence") < threshold, unsure).otherwise(F.col("label"))
    out = out.withColumn("label", label)
    return out if only is None else out.where(F.col("label").isin(list(only)))


def _by_expression(df: DataFrame, judge: OptionJudge, rows: list[tuple], forced: dict[int, int], beam: int, text: str) -> DataFrame:
    """``df`` with ``label`` and ``confidence``, level by level over an array of paths in each row."""
    name, leaf, kids = {r[1]: r[2] for r in rows}, {0: False} | {r[1]: r[5] for r in rows}, {}
    for parent, node, own, hint, place, _ in rows:
        to, more = node, ""
        while to in forced:
            to = forced[to]
            more += "/" + name[to]
        kids.setdefault(str(parent), []).append({"name": own, "hint": hint, "place": place, "to": to, "more": more, "ends": leaf[to]})
    start, prefix = 0, ""
    while start in forced:
        start = forced[start]
        prefix += "/" + name[start]
    option = "struct<name:string,hint:string,place:int,to:int,more:string,ends:boolean>"
    tree = F.from_json(F.lit(json.dumps(kids)), f"map<string,array<{option}>>")  # folded to a constant
    deepest, parents = 1, {r[1]: r[0] for r in rows}
    for n in parents:
        d, up = 0, n
        while up:
            d, up = d + 1, parents[up]
        deepest = max(deepest, d)
    said = F.coalesce(cleaned(df, text), F.lit(""))
    first = F.struct(F.lit(0.0).alias("cost"), F.array(F.lit(0)).alias("rank"), F.lit(start).alias("at"), F.lit(prefix).alias("path"), F.lit(0.0).alias("logp"), F.lit(0).alias("edges"), F.lit(leaf[start]).alias("done"))
    out = df.withColumn("_text", said).withColumn("_paths", F.array(first))

    def grow(p: Column) -> Column:
        opts = F.element_at(tree, p["at"].cast("string"))
        fits = F.filter(opts, lambda o: judge.fits(F.col("_text"), o["name"], o["hint"]))
        won = F.array_min(F.transform(fits, lambda o: o["place"]))
        if judge.fallback == "last":
            won = F.coalesce(won, F.array_max(F.transform(opts, lambda o: o["place"])))
        elif judge.fallback is not None:
            won = F.coalesce(won, F.array_min(F.transform(F.filter(opts, lambda o: o["name"] == judge.fallback), lambda o: o["place"])))

        def step(o: Column, won: Column, n: Column) -> Column:
            prob = F.when(n == 1, 1.0).when(won.isNull(), 1.0 / n).when(o["place"] == won, 0.9).otherwise(0.1 / (n - 1))
            logp, edges = p["logp"] + F.log(F.greatest(prob, F.lit(1e-9))), p["edges"] + 1
            return F.struct((-logp / edges).alias("cost"), F.concat(p["rank"], F.array(o["place"])).alias("rank"), o["to"].alias("at"),
                            F.concat(p["path"], F.lit("/"), o["name"], o["more"]).alias("path"), logp.alias("logp"), edges.alias("edges"), o["ends"].alias("done"))

        # an array of one binds the choice, so that it is made once and not for each option
        made = F.transform(F.array(F.struct(opts.alias("opts"), won.alias("won"))), lambda z: F.transform(z["opts"], lambda o: step(o, z["won"], F.size(z["opts"]))))
        return F.when(p["done"], F.array(p)).otherwise(F.flatten(made))

    for _ in range(deepest):
        out = out.withColumn("_paths", F.slice(F.array_sort(F.flatten(F.transform("_paths", grow))), 1, beam))
    best = F.get("_paths", 0)
    return out.withColumn("label", F.expr("substring(_paths[0].path, 2)")).withColumn("confidence", F.exp(-best["cost"])).drop("_text", "_paths")
