"""Strict loading, rolling totals, judges, planning, ledger, notations, streams: against brute force and exact cases."""

from __future__ import annotations

import csv
import datetime as dt
import io
import json
import random
import threading

import pytest
from pyspark.sql import functions as F

from semframe.functions import regexlang, templates, text
from semframe.operators import collapse, evaluate, rolling, segment, unwrap
from semframe.operators.sequence import numbered, running_sum, with_position
from semframe.plans import judge as J
from semframe.plans import ledger, oracles as O, planner
from semframe.sources import records as R
from semframe.sources import strict_rows as S
from semframe.sources import tables
from semframe.streaming import streams

USERS = "id,Full Name,E-mail,Tel,Signup,Plan"


def test_strict_rows(spark):
    good = ['1,Ann,a@b,,2025-01-31,free', '"2","Bob ""B"" X",,"1;2",2024-02-29,', '3,"a,b",x@y,t,2025-01-01,pro\r', "4,Żółć,,a\u0001b,2025-01-01,team", '5,Xu,,"\u0001,x",2025-01-01,']
    bad = {
        "1,Ann,a@b,,2025-01-31": "too_few_columns", "1,Ann,a@b,,2025-01-31,free,": "too_many_columns", '1,A"nn,,,2025-01-31,free': "broken_quoting", '1,"Ann,,,2025-01-31,free': "broken_quoting",
        '1,"Ann" x,,,2025-01-31,free': "broken_quoting", 'x,Ann,,,2025-01-31,free': "value:id", "1234567890,Ann,,,2025-01-31,free": "value:id", "1,...,,,2025-01-31,free": "value:Full Name",
        "1,A\u0007nn,,,2025-01-31,free": "value:Full Name", "1,A�nn,,,2025-01-31,free": "value:Full Name", "1,Ann,a@b@c,,2025-01-31,free": "value:E-mail", "1,Ann,a@ b,,2025-01-31,free": "value:E-mail",
        "1,Ann,@b,,2025-01-31,free": "value:E-mail", "1,Ann,,,2025-02-29,free": "value:Signup", "1,Ann,,,2025-1-31,free": "value:Signup", "1,Ann,,,2025-01-31,Free": "value:Plan", " ": "too_few_columns",
        '1,Ann,,,"2025-01-31" ,free': "broken_quoting", "١,Ann,,,2025-01-31,free": "value:id",
    }
    cut = "cust_id;acct_nm;prim_cntct;prim_cntct_eml;ph_1;created_ts;mrr_usd;tier_cd;rgn"
    cgood = ["1;;;;;2025-01-01T23:59:59Z;12.50;STD;", '2;"a;b";c;d@e;;2025-01-01T00:00:00Z;;;x']
    cbad = {"1;;;;;2025-01-01T24:00:00Z;;;": "value:created_ts", "1;;;;;2025-01-01 10:00:00;;;": "value:created_ts", "1;;;;;2025-01-01T10:00:00Z;1.5;;": "value:mrr_usd", "1;;;;;2025-01-01T10:00:00Z;;std;": "value:tier_cd"}
    tab = USERS.replace(",", "\t")
    tgood, tbad = ['1\tA "q\t\t\t2025-01-01\t'], {'1\t"A\tB"\t\t\t2025-01-01\t': "too_many_columns"}
    files = {"users-1.csv": (USERS, good, bad), "cutv-export-1.csv": (cut + "\r", cgood, cbad), "users-2.tsv": (tab, tgood, tbad), "users-3.csv": (USERS, [], {}), None: (USERS, ["7,Zoe,,,2025-01-01,"], {"z": "too_few_columns"})}
    rows, want = [], {}
    for f, (head, g, b) in files.items():
        lines = [head, *g, "", "\r", *b, *list(b)[:1], None]
        rows += [(f, i, t) for i, t in enumerate(lines, 1)]
        want |= {(f, i): b[t] for i, t in enumerate(lines, 1) if t in b}
    rows += [("other.csv", 1, "Full Name,id,E-mail,Tel,Signup,Plan"), ("other.csv", 2, "1,Ann,,,2025-01-31,free"), ("more.csv", 1, "note,cust_id"), ("more.csv", 2, "x,1")]
    want |= {("other.csv", 2): "unknown_layout", ("more.csv", 2): "unknown_layout"}
    rows.append(("lost.csv", 2, "1,Ann,,,2025-01-31,free"))
    want["lost.csv", 2] = "no_header"
    df = spark.createDataFrame(rows, "file string, num bigint, text string").withColumn("header", F.lit("clash")).withColumn("reason", F.lit(1))
    got = S.rejects(df).collect()
    assert {(r["file"], r["num"]): r["reason"] for r in got} == want and len(got) == len(want)
    users = S.strict_load(S.raw_lines(df), S.USERS).orderBy("id").collect()
    assert {r["full_name"] for r in users} == {"Ann", 'A "q', 'Bob "B" X', "a,b", "Żółć", "Xu", "Zoe"} and len(users) == 7
    for line in good:  # an independent reader agrees on the cells
        cells = next(csv.reader(io.StringIO(line.rstrip("\r"))))
        assert any(r["full_name"] == cells[1] and r["tel"] == cells[3] for r in users)
    accounts = S.strict_load(S.raw_lines(df), S.CUTV_EXPORT).orderBy("cust_id").collect()
    assert [r["mrr_usd"] for r in accounts] == [12.5, None] and accounts[0]["created_ts"] == dt.datetime(2025, 1, 1, 23, 59, 59)
    assert S.rejects(df.limit(0)).count() == 0


def test_rolling(spark):
    rnd = random.Random(6)
    day0 = dt.date(2025, 1, 1)
    rows = []
    for i in range(500):
        tool = rnd.choice(["a", "a", "a", "b", "c", None])
        rows.append((i, day0 + dt.timedelta(days=rnd.choice([rnd.randrange(0, 90), rnd.randrange(0, 9)])), tool, rnd.choice([None, 0.0, round(rnd.random() * 9, 6)]), rnd.choice([None, rnd.randrange(1000)]), dt.datetime(2025, 1, 1)))
    twice = rows[:40]
    rows += [(None, day0, "n", 1.5, 3, None), (None, day0, "n", 1.5, 3, None), (9000, None, "a", 5.0, 5, None), (9001, day0, "a", float("nan"), 1, None)]
    df = spark.createDataFrame(rows + twice, "entry_id bigint, day date, tool string, usd double, tokens bigint, recorded_at timestamp").withColumn("micros", F.lit("clash")).withColumn("entity", F.lit(0))
    got = {(r["tool"], r["day"]): r for r in rolling.rolling_totals(df, windows=(3, 30)).collect()}
    by = {}
    for _, d, t, u, k, _ in rows:
        if d is not None:
            x = by.setdefault(t, {}).setdefault(d, [0, 0])
            x[0] += 0 if u is None or u != u else round(u * 1e6)
            x[1] += k or 0
    n = 0
    for t, days in by.items():
        first, last = min(days), max(days)
        for i in range((last - first).days + 1):
            d = first + dt.timedelta(days=i)
            r = got[t, d]
            n += 1
            for w in (3, 30):
                span = [days.get(d - dt.timedelta(days=j), [0, 0]) for j in range(min(w, i + 1))]
                assert r[f"usd_{w}"] == pytest.approx(sum(x[0] for x in span) / 1e6) and r[f"tokens_{w}"] == sum(x[1] for x in span)
                assert r[f"avg_usd_{w}"] == pytest.approx(sum(x[0] for x in span) / 1e6 / len(span)) and r[f"max_usd_{w}"] == max(x[0] for x in span) / 1e6
    assert n == len(got)
    assert rolling.rolling_totals(df.limit(0)).count() == 0


def test_monoid_queue():
    q, plain, rnd = rolling.MonoidQueue(lambda a, b: a + b, ""), [], random.Random(1)  # concatenation: no inverse, not commutative
    for i in range(500):
        if plain and rnd.random() < 0.45:
            q.pop()
            plain.pop(0)
        else:
            q.push(chr(97 + i % 26))
            plain.append(chr(97 + i % 26))
        assert q.total() == "".join(plain) and len(q) == len(plain)


def test_sequence(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "a", "b", None]), i, rnd.randrange(5)) for i in rnd.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "g string, k bigint, v bigint")
    got = numbered(df, ["g"], ["k"]).collect()
    for g in ("a", "b", None):
        mine = sorted((r["k"], r["num"]) for r in got if r["g"] == g)
        assert [n for _, n in mine] == list(range(1, len(mine) + 1))
    pos = with_position(df, ["k"]).collect()
    assert [r["pos"] for r in sorted(pos, key=lambda r: r["k"])] == list(range(300))
    some = numbered(df.where("g is not null"), ["g"], ["k"])
    run = running_sum(some, F.col("v"), "s", ["g"], block=16).collect()
    for g in ("a", "b"):
        total = 0
        for r in sorted((r for r in run if r["g"] == g), key=lambda r: r["num"]):
            total += r["v"]
            assert r["s"] == total


def test_segment_min_by_brute_force(spark):
    rnd = random.Random(3)
    texts = ["\n".join(rnd.choice(["NEW x", "y", "z"]) for _ in range(rnd.randrange(1, 60))) + "\n" for _ in range(6)]
    got = segment.sem_segment(R.from_strings(spark, texts), O.new_marker(), min_len=4).orderBy("file_idx", "num").collect()
    for i, t in enumerate(texts):
        since, seg = 0, 1
        for r, line in zip([r for r in got if r["file_idx"] == i], t.splitlines()):
            cut = since >= 4 and "NEW" in line
            seg, since = (seg + 1, 1) if cut else (seg, since + 1)
            assert (r["cut"], r["segment"]) == (cut, seg)


def test_streams_equal_batch(spark, tmp_path):
    rnd = random.Random(4)
    lines = {f: [rnd.choice(["NEW part", "goes on", "Stops here.", "", "- item", "> quote", "> more", "```", "an exam-", "    code"]) for _ in range(120)] for f in ("f1", "f2")}
    for b in range(3):
        rows = [(f, i + 1, lines[f][i], False) for f in lines for i in range(b * 40, b * 40 + 40)]
        if b == 2:
            rows += [(f, 1000, None, True) for f in lines]
        spark.createDataFrame(rows, streams.INPUT).coalesce(1).write.parquet(str(tmp_path / f"in/b{b}"))
    batch = spark.createDataFrame([(f, i + 1, t) for f in lines for i, t in enumerate(lines[f])], "file string, num bigint, text string")

    def stream():
        return spark.readStream.schema(streams.INPUT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))

    def same(name, got, want, cols):
        got = streams.drain(got, name, str(tmp_path / name))
        key = lambda df: sorted(tuple(r[c] for c in cols) for r in df.collect())
        assert key(got) == key(want)

    same("s1", streams.stream_collapse(stream(), streams.same_first_word), collapse.sem_collapse(batch, O.same_first_word(), group=["file"]), ["file", "num", "n", "text"])
    same("s2", streams.stream_segment(stream(), streams.new_marker, min_len=3), segment.sem_segment(batch, O.new_marker(), min_len=3, group=["file"]), ["file", "num", "text", "cut", "segment"])
    same("s3", streams.stream_unwrap(stream(), streams.lowercase_start, dehyphen=True), unwrap.sem_unwrap(batch, O.lowercase_start(), dehyphen=True, group=["file"]), ["file", "num", "n", "text"])
    plain = spark.readStream.schema(streams.INPUT).parquet(str(tmp_path / "in/*")).where("text is not null").select("file", "num", "text")
    assert len(streams.stop_after(plain, 5, str(tmp_path / "s4"), ("file", "num"))) == 5


def test_packing_of_requests():
    lim = J.Limits(questions=3)
    assert [len(x) for x in J.pack(["a"] * 10, [5] * 10, [5] * 10, lim)] == [3, 3, 3, 1]
    assert len(J.pack(list("AABBA"), [5] * 5, [5] * 5, J.Limits())) == 3
    assert len(J.pack(["a"] * 25, [5] * 25, [5] * 25, J.Limits(questions=2))) == 13
    assert J.pack(["a"] * 3, [5] * 3, [5, 40_000, 5], J.Limits()) == [[0], [1], [2]]


def test_batch_judge(spark):
    def handler(req):
        if len(req["questions"]) > 4:
            raise J.Overlimit("too many")
        out = []
        for q in req["questions"]:
            t = q["instructions"]["text"]
            if t == "bad":
                raise RuntimeError("no")
            out.append({"noul": 0.95 if "yes" in t else 0.05})
        return out

    from semframe.operators.filter import sem_filter

    df = R.from_strings(spark, ["".join(f"{'yes' if i % 3 == 0 else 'no'} {i}\n" for i in range(40))])
    judged = sem_filter(df, J.BatchJudge(handler), "q").orderBy("num").collect()
    assert [r["verdict"] for r in judged] == ["selected" if i % 3 == 0 else "rejected" for i in range(40)]
    bad = sem_filter(R.from_strings(spark, ["yes\nbad\n"]), J.BatchJudge(handler, J.Limits(questions=1)), "q").orderBy("num").collect()
    assert [r["verdict"] for r in bad] == ["selected", "failed"] and "no" in bad[1]["error"]
    huge = sem_filter(R.from_strings(spark, ["yes\n" + "x1" * 30_000 + "\n"]), J.BatchJudge(handler), "q").orderBy("num").collect()
    assert [r["verdict"] for r in huge] == ["selected", "failed"]
    runs = collapse.sem_collapse(R.from_strings(spark, ["a\na\nb\n"]), J.BatchJudge(lambda req: [{"noul": float(q["instructions"]["f1"] == q["instructions"]["f2"])} for q in req["questions"]]))
    assert [r["n"] for r in runs.orderBy("num").collect()] == [2, 1]


def test_planner(spark):
    df = R.from_strings(spark, ["line one\n" * 300])
    ask = J.Ask("noul", "q?", {"text": F.col("text")})
    q, e = planner.plan(df, ask, price=0.04), planner.plan(df, ask, price=0.04, exact=True)
    assert (q.questions, q.requests) == (e.questions, e.requests) == (300, 3) and abs(q.tokens - e.tokens) <= 3 and q.usd == pytest.approx(q.tokens * 4e-8)
    assert planner.plan(df.limit(0), ask).questions == 0
    assert planner.price_of("gate/ModelX-2", {"model": 1.0, "modelx": 2.0}) == 2.0 and planner.price_of("other", {"model": 1.0}) is None
    assert planner.bisect_bound(600, 16, 10, 5) == planner.Quote(50, 3, 3 * 10 + 50 * 5)
    planner.confirm(planner.Quote(1, 1, 1, 0.5), max_cost=1.0)
    for kw in ({"max_cost": 0.1}, {"daily_left": 0.1}, {"monthly_left": 0.2}, {"confirm_above": 0.1}):
        with pytest.raises(planner.BudgetExceeded):
            planner.confirm(planner.Quote(1, 1, 1, 0.5), **kw)
    with pytest.raises(planner.BudgetExceeded):
        planner.confirm(planner.Quote(1, 1, 1, None), daily_left=5)
    assert planner.PerQuestion().per(100, 10, "choice", 3, J.Limits()) == 88 + 47 + 24


def test_ledger(spark, tmp_path):
    path, day = str(tmp_path / "ledger"), dt.date(2026, 1, 31)
    ledger.add_spend(path, "old", 1.0, 1, day - dt.timedelta(days=70))
    workers = [threading.Thread(target=lambda: [ledger.add_spend(path, "t", 0.25, 10, day) for _ in range(5)]) for _ in range(4)]
    for w in workers:
        w.start()
    for w in workers:
        w.join()
    with open(path, "a") as f:
        f.write("broken line\n2026-01-30\tu\t0.5\tx\n2026-01-30\tu\t0.500000\t7\n")
    df = ledger.read_ledger(spark, path)
    assert sorted(tuple(r) for r in df.collect()) == [(dt.date(2026, 1, 30), "u", 0.5, 7), (day, "t", 5.0, 200)]
    assert [r["usd"] for r in ledger.spend_by_day(df, day, 3).orderBy("day").collect()] == [0.0, 0.5, 5.0]
    assert tuple(ledger.spent(df, day).collect()[0]) == (5.0, 5.5)
    assert [r["tool"] for r in ledger.spend_by_tool(df, "2026-01").collect()] == ["t", "u"]


def test_notations():
    assert templates.template("is red.") == "Is it true that `text` is red?" and templates.template("Is it red?") == "Regarding `text`: Is it red?" and templates.template("Is {1} like {}?") == "Is `f1` like `text`?"
    s = templates.parse_specs(["a: b", "which [x|y=why]", "how <lo|hi>"])
    assert [(x.name, x.kind) for x in s] == [("a", "noul"), ("q2", "choice"), ("q3", "score")] and s[1].options[1].description == "why"
    assert templates.parse_band("0.3:0.7") == (0.3, 0.7)
    for bad in ("0.9:0.1", "x", "0.1", "-1:1"):
        with pytest.raises(ValueError):
            templates.parse_band(bad)
    with pytest.raises(ValueError):
        templates.parse_labels(["a", "a"])
    q = templates.parse_question_json(json.dumps({"b": {"type": "choice", "instructions": "i", "criteria": {"x": "", "y": "d"}}, "a": {"type": "noul", "instructions": "n"}}))
    assert [x.name for x in q] == ["b", "a"]
    with pytest.raises(ValueError):
        templates.parse_question_json('{"a": {"type": "odd"}}')
    assert [x.name for x in templates.parse_label_file("# c\na\tdesc\n\nb\n")] == ["a", "b"] and templates.unescape_delimiter(r"\t\\n") == "\t\\n"
    assert regexlang.parse_set(r"a-c\n[:digit:]") == ["a", "b", "c", "\n", *"0123456789"]
    for bad in ("c-a", "[:nope:]", "", "\\q"):
        with pytest.raises(ValueError):
            regexlang.parse_set(bad)
    assert regexlang.translation(list("aba"), list("xyz")) == {"a": "z", "b": "y"}
    assert regexlang.expand("$1x ${1}x $name $$ $9", ["all", "one"], {"name": 1}) == " onex one $ "
    for bad in (r"(a)\1", "(?=a)", "(?<!a)", "a++"):
        with pytest.raises(ValueError):
            regexlang.re2_to_java(bad)


def test_records_and_text(spark, tmp_path):
    cases = [("a\nb\n", "lines", ["a", "b"]), ("a\r\nb\r", "lines", ["a", "b\r"]), ("\n\nx", "lines", ["", "", "x"]), ("", "lines", []), ("a\nb\0c", "nul", ["a\nb", "c"]),
             ("\n\na\nb\n\n\nc\r\n\r\nd\n", "para", ["a\nb", "c", "d"]), ("\n\r\n", "para", [])]
    for t, mode, want in cases:
        assert [r["text"] for r in R.from_strings(spark, [t], mode).orderBy("num").collect()] == want
    f1, f2 = tmp_path / "a.txt", tmp_path / "b.txt"
    f1.write_text("x\ry\nz\r\n")
    f2.write_text("q\n" * 3)
    df, missing = R.read_records(spark, [str(f2), str(tmp_path / "no"), str(f1)], missing="skip")
    assert missing == [str(tmp_path / "no")] and [(r["file_idx"], r["num"], r["text"]) for r in df.orderBy("file_idx", "num").collect()] == [(0, 1, "q"), (0, 2, "q"), (0, 3, "q"), (2, 1, "x\ry"), (2, 2, "z")]
    with pytest.raises(FileNotFoundError):
        R.read_records(spark, [str(tmp_path / "no")])
    got = R.read_lines(spark, [str(f1), str(f2)]).orderBy("file_idx", "num").collect()
    assert [(r["file_idx"], r["num"], r["text"]) for r in got] == [(0, 1, "x\ry"), (0, 2, "z"), (1, 1, "q"), (1, 2, "q"), (1, 3, "q")]
    one = spark.createDataFrame([("\x1b[31mred\x1b[0m\x07\tx\x1b]0;t\x07!",)], "t string")
    assert one.select(text.clean(F.col("t"))).collect()[0][0] == "red\tx!"
    for t in ("abc 123, ü\n", "", "a" * 500):
        assert spark.createDataFrame([(t,)], "t string").select(text.estimate(F.col("t"))).collect()[0][0] == text.estimate_py(t)
    whole = spark.createDataFrame([(0, "f", "aaaa bbbb\n" * 50 + "c" * 300)], "file_idx int, file string, text string")
    parts = [r["text"] for r in R.chunked(whole, 20).orderBy("chunk").collect()]
    assert "".join(parts) == "aaaa bbbb\n" * 50 + "c" * 300 and all(text.estimate_py(p) <= 21 for p in parts)
    t = tmp_path / "t.csv"
    t.write_text('Name,Mail\n"A, B",x@y\nshort\nlast,"q ""z"""\n')
    head, rows = tables.read_table(spark, str(t))
    cells = rows.orderBy("num").collect()
    assert head == ["Name", "Mail"] and [r["cells"] for r in cells] == [["A, B", "x@y"], ["short"], ["last", 'q "z"']]
    assert [r[0] for r in rows.orderBy("num").select(tables.to_lines(rows, ",")).collect()] == ['"A, B",x@y', "short", 'last,"q ""z"""']
    tables.write_records(R.from_strings(spark, ["b\na\n"]), str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["b", "a"]


def test_evaluate_by_brute_force(spark):
    rnd = random.Random(8)
    rows = [(round(rnd.random(), 1), rnd.randrange(2)) for _ in range(200)]
    r = evaluate.evaluate(spark.createDataFrame(rows + [(None, 1), (0.5, None)], "p double, label int")).collect()[0]
    pos, neg = [p for p, y in rows if y], [p for p, y in rows if not y]
    assert r["auc"] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
    acc = lambda t: sum((p >= t) == (y == 1) for p, y in rows) / len(rows)
    assert r["accuracy"] == pytest.approx(acc(0.5)) and r["best_accuracy"] == pytest.approx(max(acc(t) for t in (0.5, *evaluate.GRID)))
    assert evaluate.evaluate(spark.createDataFrame([(0.5, 1)], "p double, label int")).collect()[0]["auc"] is None


def test_stream_neighbours_over_batches(spark, tmp_path):
    texts = [f"t{i}" for i in range(11)]
    cuts = [(0, 1), (1, 2), (2, 7), (7, 11)]
    for b, (lo, hi) in enumerate(cuts):
        rows = [("f", i + 1, texts[i], False) for i in range(lo, hi)] + ([("f", 99, None, True)] if hi == 11 else [])
        spark.createDataFrame(rows, streams.INPUT).coalesce(1).write.parquet(str(tmp_path / f"in/b{b}"))
    s = spark.readStream.schema(streams.INPUT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    got = streams.drain(streams.stream_neighbours(s, 2), "near", str(tmp_path / "c")).orderBy("num").collect()
    assert [(r["text"], r["before"], r["after"]) for r in got] == [(t, texts[max(0, i - 2) : i] or None, texts[i + 1 : i + 3] or None) for i, t in enumerate(texts)]


def test_durable_frames(spark):
    from semframe.session import durable, release

    df = spark.createDataFrame([(1, {"a": [1.5]}, None), (2, None, "x")], "k int, m map<string,array<double>>, `odd.name, of` string")
    kept = durable(df)
    assert kept.schema.simpleString() == df.schema.simpleString() and sorted(map(str, kept.collect())) == sorted(map(str, df.collect()))
    assert durable(df.limit(0)).count() == 0
    odd = df.select("k", F.col("k").alias("K"), F.lit(None).alias("nothing"))
    assert durable(odd).count() == 2
    where = kept._written_at
    release(kept)
    import os

    assert not os.path.exists(where.removeprefix("file:"))


def test_records_of_a_micro_batch(spark, tmp_path):
    import pandas as pd

    parts = [pd.DataFrame({"num": [3, 1], "text": ["c", None], "eof": [None, False]}), pd.DataFrame({"num": [9, 2], "text": [None, "b"], "eof": [True, False]})]
    assert streams._records(iter(parts)) == ([(1, ""), (2, "b"), (3, "c")], True)
    assert streams._records(iter([pd.DataFrame({"num": [1, 1], "text": ["x", float("nan")], "eof": [float("nan"), float("nan")]})])) == ([(1, "x"), (1, "")], False)
    spark.createDataFrame([("f", 1, "a", False), ("f", 2, "b", False), ("f", 3, None, True)], streams.INPUT).write.parquet(str(tmp_path / "in/b0"))
    s = streams.stream_neighbours(spark.readStream.schema(streams.INPUT).parquet(str(tmp_path / "in/*")), 1)
    got = streams.drain(s, "near_files", str(tmp_path / "c"))
    assert got.inputFiles() and sorted((r["text"], r["before"], r["after"]) for r in got.collect()) == [("a", None, ["b"]), ("b", ["a"], None)]


@pytest.mark.parametrize("name", ["stream_unwrap", "stream_collapse", "stream_segment"])
def test_drained_streams_stay_off_the_driver(spark, tmp_path, name):
    spark.createDataFrame([("f", 1, "a", False), ("f", 2, "b", False), ("f", 3, None, True)], streams.INPUT).write.parquet(str(tmp_path / "in/b0"))

    def drained():
        s = getattr(streams, name)(spark.readStream.schema(streams.INPUT).parquet(str(tmp_path / "in/*")), streams.lowercase_start)
        return streams.drain(s.withColumn("nothing", F.lit(None)), f"kept_{name}", str(tmp_path / "c"))

    got, n = drained(), 2 if name == "stream_segment" else 1
    assert got.inputFiles() and got.count() == spark.table(f"kept_{name}").count() == got.where("nothing is null").count() == n
    # a stream that is drained again adds what has come since
    spark.createDataFrame([("g", 1, "c", False), ("g", 2, None, True)], streams.INPUT).write.parquet(str(tmp_path / "in/b1"))
    assert sorted({r["file"] for r in drained().collect()}) == ["f", "g"]
