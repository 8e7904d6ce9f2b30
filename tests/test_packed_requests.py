import random

import pytest
from pyspark.sql import functions as F

from semframe.operators.windows import choose_in_windows
from semframe.plans.judge import BatchJudge, Limits, Overlimit, pack
from semframe.plans.planner import packed_requests


@pytest.mark.parametrize("limits", [Limits(), Limits(request_tokens=2_000, question_tokens=1_500, questions=9)])
def test_requests_are_those_of_the_packer(spark, limits):
    """Against ``judge.pack``: full by questions, full by tokens, lone questions, unknown sizes, states over many blocks."""
    rnd = random.Random(5)
    rows, item = [], 0
    for state, n in ((None, 40), ("a", 1), ("b", 700), ("c", 128), ("d", 129), ("e", 300), ("f", 5), ("hot", 2500)):
        st = rnd.choice([19, 300, 900])
        for _ in range(n):
            big = rnd.random()
            est = None if big < 0.01 else 60_000 if big < 0.02 else rnd.randint(900, 28_000) if big < 0.1 else rnd.randint(0, 30 if state == "b" else 900)
            rows.append((item, state, st, est))
            item += 1
    df = spark.createDataFrame(rnd.sample(rows, len(rows)), "item_id long, state_id string, state_est int, est int").repartition(5)
    got = {r["item_id"]: (r["state_id"], r["request"]) for r in packed_requests(df, group=["state_id"], by=["item_id"], limits=limits, block=256).collect()}
    want = {}
    for state in {r[1] for r in rows}:
        mine = sorted(r for r in rows if r[1] == state)
        sizes = [10**9 if r[3] is None else r[3] for r in mine]
        for k, idx in enumerate(pack([state or ""] * len(mine), [r[2] for r in mine], sizes, limits)):
            want |= {mine[i][0]: (state, k) for i in idx}
    assert len(got) == len(rows) and got == want


def test_answers_stay_beside_their_windows(spark):
    """Many like answers take few bytes on disk; joined back by that size they went whole through the driver."""
    def first(request):
        options = request["questions"][0]["criteria"]
        if len(options) > 5:
            raise Overlimit("5")
        return [{"probabilities": {k: float(k == "L0002") for k in options}}, {"noul": 0.9}][: len(request["questions"])]

    rows = [(f, 10 * f + i, f"line {i}", "a") for f in range(3) for i in range(2 * f + 1)]
    df = spark.createDataFrame(rows, "num_of_file long, num long, text string, window string").withColumn("_text", F.col("text"))
    got = choose_in_windows(df, BatchJudge(first), "Which one?", "Any?", ["num_of_file"])
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.columns == [*df.columns, "p", "exists"]
    assert sorted(tuple(r) for r in got.collect()) == [(f, n, t, w, t, float(n % 10 == 1), 0.9) for f, n, t, w in rows]
    more = spark.createDataFrame([(0, i, "x" * i, "a") for i in range(8)], "file long, num long, text string, window string").withColumn("_text", F.col("text"))
    halved = choose_in_windows(more, BatchJudge(first), "Which one?", None, ["file"]).orderBy("num").collect()
    assert [(r["num"], r["window"], r["p"], len(r["text"])) for r in halved] == [(i, "a.0" if i < 4 else "a.1", float(i in (1, 5)), i) for i in range(8)]
