"""Walk a tree of names to what a description names: beam search, one choice per open directory and round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semframe.operators.options import OptionJudge, choose_among, each_option
from semframe.plans.judge import Ask, Judge
from semframe.session import durable

# Options of one choice, the probability under which a branch is dropped, rounds, and what is printed.
MAX_OPTIONS, PRUNE, ROUNDS = 255, 0.005, 64
LEAST, LEAST_VERIFIED = 0.15, 0.5
HERE, NONE = ".", "(none)"
#: Names beneath a directory that its option shows, and in a choice of all directories together.
SAMPLE, SAMPLED_NAMES = 40, 3000
#: Parts of a directory in which names are looked for first.
PARTS = 16


def path_words() -> OptionJudge:
    """An option is meant if all parts of its name are words of the query; ``.`` if the query says HERE; else nothing."""

    def fits(text: Column, option: Column, hint: Column) -> Column:
        words = F.split(text, "\\s+")
        parts = F.filter(F.split(option, "/"), lambda x: x != "")
        return F.when(option == HERE, F.array_contains(words, "HERE")).when(option == NONE, F.lit(False)).otherwise(F.forall(parts, lambda x: F.array_contains(words, x)))

    return OptionJudge(fits, fallback=NONE)


def names_beneath(eligible: DataFrame, places: DataFrame, most: Column) -> DataFrame:
    """``path, names``: for each directory of ``places`` the names beneath it, breadth first, at most ``most`` of them (a column of
    ``places``).  Found in parts of a directory first, so a large one is not sorted in one task."""
    steps = F.split("path", "/")
    up = eligible.select("path", F.size(steps).alias("deep"), steps.alias("steps")).where("deep > 1")
    above = up.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("deep") - 1))).select(
        F.array_join(F.slice("steps", F.lit(1), F.col("k")), "/").alias("dir"), (F.col("deep") - F.col("k")).alias("below"), F.array_join(F.expr("slice(steps, k + 1, deep - k)"), "/").alias("name"))
    found = above.join(places.select(F.col("path").alias("dir"), most.alias("most")), "dir").withColumn("part", F.pmod(F.xxhash64("name"), F.lit(PARTS)))
    first = Window.partitionBy("dir", "part").orderBy("below", "name")
    some = found.withColumn("r", F.row_number().over(first)).where("r <= most").drop("r")
    some = some.withColumn("r", F.row_number().over(Window.partitionBy("dir").orderBy("below", "name"))).where("r <= most")
    return some.groupBy(F.col("dir").alias("path")).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "name"))), lambda x: x["name"]).alias("names"))


def sem_walk(nodes: DataFrame, judge: Judge, query: str, *, beam: int = 3, results: int = 1, least: float | None = None, dirs_only: bool = False,
             files_only: bool = False, verify: Judge | None = None, sample: int = SAMPLE, heads: DataFrame | None = None) -> DataFrame:
    """``path, is_dir, score, place``: the best places, best first, with the geometric mean of their probabilities.

    Options of a directory are its entries in order of name (directories with a slash), ``.`` for itself (not at the root, not
    with ``files_only``) and ``(none)``; up to 255 are one choice, more are asked about one by one and not normalised.  Chains
    of directories with a single directory in them are one step unless ``dirs_only``.  Ties keep the order of the options.
    A directory is offered with a breadth-first sample of the names beneath it: ``sample`` of them, fewer among many options.
    ``verify`` asks about the best again, by itself, and sorts by that; it sees what a file begins with, or what lies beneath a
    directory, if ``heads(path, head)`` are given (see ``records.head_of``).
    """
    if dirs_only and files_only:
        raise ValueError("directories only and files only exclude each other")
    if beam < 1 or results < 1:
        raise ValueError("beam and results are at least 1")
    if least is None:
        least = LEAST_VERIFIED if verify is not None else LEAST
    eligible = nodes.where("is_dir") if dirs_only else nodes.where("not is_dir or files > 0") if files_only else nodes
    eligible = durable(eligible.select("path", "parent", "name", "is_dir"))
    if eligible.isEmpty():
        raise ValueError("nothing to search")
    # a directory whose only entry is a directory leads straight into it
    lone = eligible.groupBy("parent").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("path", "is_dir")).alias("k")).where("n = 1 and k.is_dir").select(F.col("parent").alias("path"), F.col("k.path").alias("next"))
    lone = durable(lone if not dirs_only else lone.limit(0))

    def forward(cands: DataFrame) -> DataFrame:
        """Open directories moved along their chains."""
        while True:
            moved = cands.join(lone, "path", "left")
            if moved.where("not done and next is not null").isEmpty():
                return cands
            cands = durable(moved.withColumn("path", F.when(~F.col("done") & F.col("next").isNotNull(), F.col("next")).otherwise(F.col("path"))).drop("next"))

    spark = nodes.sparkSession
    now = forward(spark.createDataFrame([("", 0.0, 0, False, [0])], "path string, logp double, edges int, done boolean, rank array<int>"))
    score = F.when(F.col("edges") > 0, F.exp(F.col("logp") / F.col("edges"))).otherwise(1.0)
    finished = None
    for _ in range(ROUNDS):
        live = now.where("not done")
        if live.isEmpty():
            break
        kids = live.join(eligible.select(F.col("parent").alias("path"), F.col("path").alias("to"), F.concat("name", F.when(F.col("is_dir"), "/").otherwise("")).alias("option"), F.col("is_dir").alias("opens")), "path", "left")
        place = F.row_number().over(Window.partitionBy("path").orderBy("option"))
        # a directory is in at most ``beam`` live rows, its entries are what one question holds
        rows = kids.withColumn("place", F.when(F.col("option").isNotNull(), place).otherwise(0))
        here = live.where(F.col("path") != "").withColumn("to", F.col("path")).withColumn("option", F.lit(HERE)).withColumn("opens", F.lit(False)).withColumn("place", F.lit(1 << 30)) if not files_only else None
        none = live.withColumn("to", F.lit(None).cast("string")).withColumn("option", F.lit(NONE)).withColumn("opens", F.lit(False)).withColumn("place", F.lit((1 << 30) + 1))
        some = rows.where("option is not null")
        ends = live.join(some.select("path").distinct(), "path", "left_anti").withColumn("done", F.lit(True))
        full = some.unionByName(none.join(some.select("path").distinct(), "path", "left_semi"))
        if here is not None:
            full = full.unionByName(here.join(some.select("path").distinct(), "path", "left_semi"))
        full = full.withColumn("looking_for", F.lit(query))
        sizes = full.groupBy("path").agg(F.count(F.lit(1)).alias("size"))
        full = full.join(sizes, "path")
        if isinstance(judge, OptionJudge):  # rules look at names
            full = durable(full.withColumn("hint", F.col("path")))
        else:
            each_of = F.least(F.lit(sample), F.greatest(F.lit(2), F.floor(F.lit(SAMPLED_NAMES) / F.col("size")))).cast("int")
            full = durable(full)
            shown = names_beneath(eligible, full.where("opens").select(F.col("to").alias("path"), "size").distinct(), each_of)
            hint = F.when(F.col("names").isNotNull(), F.concat(F.lit("in "), F.col("path"), F.lit("; holds "), F.array_join("names", ", "))).otherwise(F.concat(F.lit("in "), F.col("path")))
            full = durable(full.join(shown.withColumnRenamed("path", "to"), "to", "left").withColumn("hint", hint).select(*full.columns, "hint"))
        one = choose_among(full.where(F.col("size") <= MAX_OPTIONS), judge, ["path"], "Which entry is, or leads to, what `text` describes?", text="looking_for", option="option", hint="hint", place="place")
        total = F.sum("p").over(Window.partitionBy("path"))
        one = one.withColumn("p", F.when(total > 0, F.col("p") / total).otherwise(F.col("p")))
        each = each_option(full.where((F.col("size") > MAX_OPTIONS) & (F.col("option") != NONE)), judge, "Is `entry` what `text` describes, or does it lead there?", text="looking_for", option="option", hint="hint")
        judged = one.unionByName(each.select(one.columns)).where((F.col("p") >= PRUNE) & (F.col("option") != NONE) & F.col("error").isNull())
        grown = judged.select(
            F.col("to").alias("path"), (F.col("logp") + F.log("p")).alias("logp"), (F.col("edges") + 1).alias("edges"), (~F.col("opens")).alias("done"),
            F.concat("rank", F.array(F.col("place").cast("int"))).alias("rank"),
        )
        nxt = durable(now.where("done").unionByName(ends.select(now.columns)).unionByName(grown))
        done = nxt.where("done")
        finished = done if finished is None else finished.unionByName(done)
        now = forward(durable(nxt.withColumn("_s", score).orderBy(F.col("_s").desc(), "rank").limit(beam).drop("_s")))
    finished = now if finished is None else finished.unionByName(now)
    kind = nodes.select("path", "is_dir").unionByName(spark.createDataFrame([("", True)], "path string, is_dir boolean")).distinct()
    best = finished.withColumn("score", score).groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("s"), "rank")).alias("b"))
    out = best.join(kind, "path").select("path", "is_dir", (-F.col("b.s")).alias("score"), F.col("b.rank").alias("rank"))
    if dirs_only:
        out = out.where("is_dir")
    if files_only:
        out = out.where("not is_dir")
    if verify is not None:
        top = out.orderBy(F.col("score").desc(), "rank").limit(max(results, 2 * beam))
        base = F.element_at(F.split("path", "/"), -1)
        if isinstance(verify, OptionJudge):
            top = top.withColumn("score", F.when(verify.fits(F.lit(query), base, F.col("path")), 0.95).otherwise(0.05))
        else:
            about = {"text": F.lit(query), "path": F.col("path")}
            if heads is not None:
                shown = names_beneath(eligible, top.where("is_dir"), F.lit(sample)).select("path", F.array_join("names", "\n").alias("beneath"))
                top = top.join(heads.select("path", "head"), "path", "left").join(shown, "path", "left")
                about["content"] = F.coalesce("head", "beneath")
            top = verify.attach(top, Ask("noul", "Is `path` what `text` describes?", about), "_a").withColumn("score", F.col("_a.noul")).select("path", "is_dir", "score", "rank")
        out = top
    out = out.where(F.col("score") >= least).orderBy(F.col("score").desc(), "rank").limit(results)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), "rank"))  # at most ``results`` rows
    return out.withColumn("place", place).drop("rank")
