"""The tournament by packed requests: one pass per group, or rounds over all groups, with the same results."""

import random

from pyspark.sql import functions as F

from semframe.functions import text as T
from semframe.operators import pick
from semframe.plans.judge import BatchJudge, Overlimit


def by_number():
    """A handler: a line's share is the number at its end; more than 9 lines are too large."""

    def handler(request):
        lines = dict(x.split("| ", 1) for x in request["state"]["document"].split("\n"))
        if len(lines) > 9:
            raise Overlimit("9")
        ps = {k: int(x.split()[-1]) / 100 for k, x in lines.items()}
        return [{"probabilities": {k: ps[k] for k in q["criteria"]}} if q["type"] == "choice" else {"noul": max(ps.values())} for q in request["questions"]]

    return handler


def test_a_group_is_asked_until_it_has_one_window(spark):
    """It was asked again in every round that any other group needed."""
    seen, answers = spark.sparkContext.accumulator(0), by_number()

    def counted(request):
        seen.add(1)
        return answers(request)

    df = spark.createDataFrame([(g, i, f"line {i}") for g, n in (("long", 20), (None, 5), ("short", 3)) for i in range(1, n + 1)], "file string, num long, text string")
    got = pick.sem_pick(df, BatchJudge(counted), "largest?", best=2, group=["file"], window=6, threshold=0.0).collect()
    assert sorted((r["file"] or "", r["place"], r["num"], r["text"], r["p"], r["exists"]) for r in got) == [
        ("", 1, 5, "line 5", 0.05, 0.05), ("", 2, 4, "line 4", 0.04, 0.05), ("long", 1, 20, "line 20", 0.2, 0.2), ("long", 2, 19, "line 19", 0.19, 0.2),
        ("short", 1, 3, "line 3", 0.03, 0.03), ("short", 2, 2, "line 2", 0.02, 0.03)]
    assert seen.value == 4 + 2 + 1 + 1 + 1  # 20 in windows of 6, 11 finalists, 6 finalists; one each of the others


def test_only_the_best_are_written(spark, monkeypatch):
    """Records were written with every round; the text of all of them goes through one exchange now."""
    written = []
    monkeypatch.setattr(pick, "durable", lambda df, real=pick.durable: written.append((df, real(df))) or written[-1][1])
    df = spark.createDataFrame([(g, i, f"line {i}") for g in range(5) for i in range(1, 40)], "file long, num long, text string")
    assert pick.sem_pick(df, BatchJudge(by_number()), "largest?", group=["file"], window=6, threshold=0.0).count() == 5
    assert [(x.count(), df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")) for df, x in written if "text" in x.columns] == [(5, 1)]


def test_records_without_text_are_no_candidates(spark):
    """One of control characters only has no line in the document; the answer for it failed, and with it the group."""
    df = spark.createDataFrame([(1, "\x07"), (2, "a 7"), (3, "\x1b[0m"), (4, "\x1b[31mb 9\x07"), (5, "  "), (6, None)], "num long, text string").withColumn("file_idx", F.lit(0))
    got = pick.sem_pick(df, BatchJudge(by_number()), "largest?", best=9, threshold=0.0).orderBy("place").collect()
    assert [(r["num"], r["text"], r["p"]) for r in got] == [(4, "\x1b[31mb 9\x07", 0.09), (2, "a 7", 0.07)]


def test_rounds_over_all_groups_give_the_same(spark, monkeypatch):
    """Groups too long for one task, beside others; windows are halved, ties go to the earlier record."""
    rnd = random.Random(3)
    rows = [(g, i, rnd.choice(["", " ", "\x07", f"line {rnd.randint(0, 99)}", "word " * rnd.randint(1, 60) + str(rnd.randint(0, 30))])) for g, n in (("a", 90), ("b", 7), (None, 60), ("d", 30)) for i in range(1, n + 1)]
    df = spark.createDataFrame(rnd.sample(rows, len(rows)), "file string, num long, text string").repartition(3)
    run = lambda: sorted((r["file"] or "", *r[1:]) for r in pick.sem_pick(df, BatchJudge(by_number()), "largest?", best=4, group=["file"], window=12, tokens=100, threshold=0.0).collect())
    whole = run()
    monkeypatch.setattr(pick, "BLOCK", 50)
    assert run() == whole and len(whole) == 4 + 2 + 4 + 4


def test_windows_refused_down_to_single_lines_end(spark):
    """Nothing is left out between rounds then; they went on without end."""
    answers = by_number()

    def one_line(request):
        if "\n" in request["state"]["document"]:
            raise Overlimit("1")
        return answers(request)

    df = spark.createDataFrame([(0, i, f"line {i * 7 % 10}") for i in range(1, 9)], "file_idx int, num long, text string")
    got = pick.sem_pick(df, BatchJudge(one_line), "largest?", best=2, threshold=0.0).orderBy("place").collect()
    assert [(r["num"], r["p"]) for r in got] == [(7, 0.09), (4, 0.08)]


def test_windows_of_a_group_are_open_at_once(spark):
    """A handler that may have several requests open was given those of one window at a time."""
    most, answers = spark.sparkContext.accumulator(0), by_number()

    class Many:
        def __call__(self, request):
            return answers(request)

        def many(self, calls):
            most.add(len(calls) == 8)
            return (c() for c in calls)

    df = spark.createDataFrame([(0, i, f"line {i}") for i in range(1, 49)], "file_idx int, num long, text string")
    got = pick.sem_pick(df, BatchJudge(Many()), "largest?", window=6, threshold=0.0).collect()
    assert [(r["num"], r["p"]) for r in got] == [(48, 0.48)] and most.value == 1


def test_estimates_are_those_of_the_column(spark):
    rnd = random.Random(1)
    pool = ["a", "Z", "0", " ", "\t", "\n", "\r", "!", '"', "\\", "<", ">", "&", "~", "é", "°", "\x85", "\x1b[31m", "\x1b]0;t\x07", "\x1b", "\x7f", "漢", "😀", "�"]
    df = spark.createDataFrame([("".join(rnd.choices(pool, k=rnd.randint(1, 40))),) for _ in range(300)], "t string").coalesce(1)
    seen = T.clean(F.col("t"))
    rows = df.select(F.col("t").cast("binary").alias("t"), seen.alias("seen"), T.estimate(seen).alias("est"), F.to_json(F.struct(seen.alias("d"))).alias("json")).withColumn("json_est", T.estimate_json(F.col("json"))).collect()
    import pyarrow as pa

    got = T.cleaned_estimates(pa.array([bytes(r["t"]) for r in rows]).slice(5))
    assert got == ([r["seen"] for r in rows[5:]], [r["est"] for r in rows[5:]])
    assert [T.estimate_json_plain(r["json"]) for r in rows] == [r["json_est"] for r in rows]
