"""The HTTP judge against a loopback server: retries, halves, budget, failure policies."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from semframe.operators.filter import sem_filter
from semframe.plans.judge import BatchJudge, Limits
from semframe.plans.remote import HttpHandler, Refused, WaveJudge, usage
from semframe.sources import records as R


@pytest.fixture
def server():
    state = {"calls": 0, "fail_first": 0, "most": 100, "key": None, "sizes": []}

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            req = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            state["calls"] += 1
            n = len(req["questions"])
            code = 200
            if state["key"] and self.headers.get("Authorization") != f"Bearer {state['key']}":
                code = 401
            elif state["calls"] <= state["fail_first"]:
                code = 429
            elif n > state["most"]:
                code = 413
            state["sizes"].append(n)
            out = {"answers": {k: {"noul": 0.95 if "yes" in q["instructions"]["text"] else 0.05} for k, q in req["questions"].items()}}
            body = json.dumps(out).encode() if code == 200 else b"{}"
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    state["url"] = f"http://127.0.0.1:{s.server_address[1]}/"
    yield state
    s.shutdown()


def ask(n):
    return {"state": "s", "questions": [{"type": "noul", "instructions": {"text": "yes" if i % 2 else "no"}} for i in range(n)]}


def test_handler(server):
    server["fail_first"] = 2
    h = HttpHandler(server["url"], first_pause=0.01)
    assert [a["noul"] for a in h(ask(3))] == [0.05, 0.95, 0.05] and server["calls"] == 3
    h(ask(3))
    assert server["calls"] == 3  # equal requests are not paid twice
    server["key"] = "k"
    with pytest.raises(Refused):
        HttpHandler(server["url"])(ask(1))
    assert len(HttpHandler(server["url"], key="k")(ask(2))) == 2


def test_filter_over_http(spark, server):
    server["most"] = 4
    df = R.from_strings(spark, ["".join(f"{'yes' if i % 3 == 0 else 'no'} {i}\n" for i in range(30))]).coalesce(1)
    got = sem_filter(df, BatchJudge(HttpHandler(server["url"]), Limits(questions=10)), "q").orderBy("num").collect()
    assert [r["verdict"] == "selected" for r in got] == [i % 3 == 0 for i in range(30)] and max(server["sizes"]) == 10 and min(server["sizes"]) <= 4


def test_waves(spark, server):
    df = R.from_strings(spark, ["yes line\n" * 50])
    j = WaveJudge(BatchJudge(HttpHandler(server["url"])), rows_per_wave=10, max_tokens=800)
    got = sem_filter(df, j, "q")
    u = usage(got).collect()[0]
    assert 0 < u["answered"] < 50 and u["answered"] % 10 == 0 and u["left"] == 50 - u["answered"] and j.spent_tokens <= 800
    calls = server["calls"]
    got.collect()
    assert server["calls"] == calls  # reading again asks nothing
    with pytest.raises(RuntimeError):
        sem_filter(df, WaveJudge(BatchJudge(HttpHandler("http://127.0.0.1:9/", retries=0)), on_fail="stop"), "q")


def says():
    """A handler by words, made here so that workers need not import this module."""

    def answer(request):
        return [{"noul": 0.9 if "yes" in q["instructions"]["text"] else 0.1} for q in request["questions"]]

    return answer


def test_no_row_is_lost_by_later_uses(spark):
    df = R.from_strings(spark, ["".join(f"{'yes' if i % 2 else 'no'} {i}\n" for i in range(50))])
    j = WaveJudge(BatchJudge(says()), rows_per_wave=10, max_tokens=900)
    seen = []
    for _ in range(4):
        got = sem_filter(df, j, "q").select("num", "p", "error").orderBy("num").collect()
        assert [r["num"] for r in got] == list(range(1, 51))
        assert all((r["error"] == "budget") == (r["p"] is None) for r in got)
        seen.append(sum(r["error"] is None for r in got))
    assert 0 < seen[0] < 50 and seen[1:] == [0, 0, 0] and j.spent_tokens <= 900


def test_stop_after_enough(spark):
    from pyspark.sql import functions as F

    from semframe.plans.judge import Ask

    df = R.from_strings(spark, ["".join(f"{'yes' if i % 5 == 0 else 'no'} {i}\n" for i in range(60))]).coalesce(1)
    j = WaveJudge(BatchJudge(says()), rows_per_wave=10)
    got = j.attach_until(df, Ask("noul", "q", {"text": F.col("text")}), "a", F.col("a.noul") >= 0.5, 3).orderBy("num").collect()
    assert len(got) == 60 and [r["num"] for r in got if r["a"]["noul"] is not None] == list(range(1, 21)) and got[-1]["a"]["error"] == "stopped"


def test_a_refusal_ends_the_run(spark, server):
    server["key"] = "k"
    df = R.from_strings(spark, ["line\n" * 5])
    with pytest.raises(Exception, match="Refused"):
        sem_filter(df, BatchJudge(HttpHandler(server["url"])), "q").collect()


def test_open_requests_and_rates(server):
    h = HttpHandler(server["url"], first_pause=0.01, most_open=4)
    got = list(h.many([lambda n=n: h(ask(n)) for n in range(1, 12)]))
    assert [len(g) for g in got] == list(range(1, 12)) and h.open == 4
    h._refused()
    assert h.open == 2
    slow = HttpHandler(server["url"], per_minute=1200, tokens_per_minute=1e6, burst=0)
    import time

    t = time.time()
    for n in range(20, 26):
        slow(ask(n))
    assert time.time() - t >= 0.2


def test_windows_are_one_request_each(spark):
    """Boundaries of a window go out together, with the record before it and the context shown once."""
    from pyspark.sql import functions as F

    from semframe.operators import pick, segment

    seen = spark.sparkContext.accumulator(0)

    def handler(request):
        seen.add(1)
        lines = request["state"]["document"].split("\n")
        assert request["state"]["about"] == "a log" and lines[0].startswith(("R0001| ", "L0001| "))
        out = []
        for q in request["questions"]:
            if q["type"] == "choice":
                out.append({"probabilities": {k: float("ANSWER" in x) for k, x in zip(q["criteria"], lines)}})
            else:
                tag = q["instructions"]["question"].split()[-1].rstrip("?")
                out.append({"noul": float("ANSWER" in request["state"]["document"]) if tag not in request["state"]["document"] else float("NEW" in next(x for x in lines if x.startswith(tag)))})
        return out

    df = R.from_strings(spark, ["".join(f"{'NEW' if i % 10 == 9 else 'on'} {i}\n" for i in range(200)), "single\n"])
    got = segment.sem_segment(df, BatchJudge(handler), context={"about": "a log"}, around=2).orderBy("file_idx", "num").collect()
    assert [r["num"] for r in got if r["cut"]] == [i for i in range(2, 201) if i % 10 == 0] and len(got) == 201
    assert seen.value == 4  # 200 records in windows of 64; a single record has no boundary
    df = R.from_strings(spark, ["".join(f"{'ANSWER' if i == 399 else 'line'} {i}\n" for i in range(600))])
    best = pick.sem_pick(df, BatchJudge(handler), "where?", context={"about": "a log"}).collect()
    assert [(r["num"], r["exists"]) for r in best] == [(400, 1.0)]
    assert seen.value == 4 + 3 + 1  # three windows, then their finalists
    assert df.select(F.count("num")).collect()[0][0] == 600


def test_large_windows_are_halved(spark):
    from semframe.operators import pick
    from semframe.plans.judge import Overlimit

    def handler(request):
        lines = request["state"]["document"].split("\n")
        if len(lines) > 9:
            raise Overlimit("9")
        return [{"probabilities": {k: float(x.split()[-1]) for k, x in zip(q["criteria"], lines)}} if q["type"] == "choice" else {"noul": 0.8} for q in request["questions"]]

    df = R.from_strings(spark, ["".join(f"value {i % 37}\n" for i in range(100))])
    best = pick.sem_pick(df, BatchJudge(handler), "largest?", best=2).orderBy("place").collect()
    assert [r["num"] for r in best] == [37, 74]


def test_pairs_of_a_stream_by_requests():
    from semframe.plans.remote import Refused
    from semframe.streaming.streams import judged_pairs

    def handler(request):
        if any("boom" in q["instructions"]["f2"] for q in request["questions"]):
            raise ValueError("boom")
        return [{"noul": 0.9} if q["instructions"]["f1"] == q["instructions"]["f2"] else {"error": "unclear"} for q in request["questions"]]

    assert judged_pairs(handler, "same?", 2)([("a", "a"), ("a", "b"), ("c", "boom"), ("d", "d"), ("e", "e")]) == [0.9, None, None, None, 0.9]

    def refuse(request):
        raise Refused("401")

    with pytest.raises(Refused):
        judged_pairs(refuse, "same?")([("a", "b")])


def test_quotes(spark):
    from pyspark.sql import functions as F

    from semframe.plans import planner
    from semframe.plans.judge import Ask, pack
    from semframe.functions.text import estimate_json

    df = R.from_strings(spark, ["".join("word " * (i % 400) + "\n" for i in range(700))])
    ask, limits = Ask("noul", "q", {"text": F.col("text")}), Limits(request_tokens=9_000, question_tokens=400)
    ests = [r[0] for r in df.orderBy("num").select(estimate_json(ask.instructions())).collect()]
    state = df.limit(1).select(estimate_json(F.lit(ask.state()))).collect()[0][0]
    packed = pack([""] * 700, [state] * 700, ests, limits)
    q = planner.plan(df.orderBy("num"), ask, limits=limits, exact=True)
    assert (q.questions, q.requests) == (700, len(packed)) and q.tokens == len(packed) * (limits.frame + state) + sum(ests) + 700 * limits.per_question
    assert planner.pick_bound(1, 10, 100, 3, 255, 262).requests == 1 and planner.pick_bound(3, 600, 6000, 3, 255, 262) == planner.Quote(7, 4, 6000 + 3 * 262 + 90 + 262)
    assert planner.tree_bound(10, [1, 3, 8], 2, 50).questions == 50 and planner.walk_bound(3, 3, 100, 6).questions == 13
    assert planner.projection(500, 50, 200) == 2000


def test_one_choice_among_matches(spark):
    from semframe.operators import pick

    seen = spark.sparkContext.accumulator(0)

    def handler(request):
        seen.add(1)
        c = request["questions"][0]["criteria"]
        want = next((k for k, v in c.items() if "7" in (v or k)), None)
        return [{"probabilities": {k: float(k == want) if want else float(v == "none of them") for k, v in c.items()}}]

    df = spark.createDataFrame([(1, "pier 3, pier 7, none, pier 3"), (2, "pier 1"), (3, "nothing"), (4, "pier 7 " + "x" * 120 + " pier 70")], "k int, text string")
    got = pick.sem_pick_match(df, BatchJudge(handler), [r"pier \d+", "none", r"x{100,}"], "which?", key=["k"]).orderBy("k").collect()
    assert [(r["k"], r["span"], r["p"], r["verdict"]) for r in got] == [(1, "pier 7", 1.0, "yes"), (4, "pier 7", 1.0, "yes")] and seen.value == 3
    with pytest.raises(ValueError):
        pick.sem_pick_match(spark.createDataFrame([(1, " ".join(f"pier {i}" for i in range(300)))], "k int, text string"), BatchJudge(handler), [r"pier \d+"], "which?", key=["k"])
