"""Record operators against small models of their rules: inputs are drawn at random, results computed again in plain Python."""

from __future__ import annotations

import itertools
import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from semframe import render
from semframe.functions.templates import Label, parse_labels, parse_specs, parse_taxonomy
from semframe.functions.text import estimate
from semframe.operators import bisect, collapse, columns, edit, filter as filt, label, pick, probe, rank, segment, sort, test as whole, unwrap, walk
from semframe.operators.options import keyword_options
from semframe.plans import oracles as O
from semframe.sources import records as R
from semframe.sources import tree as T

HARBOUR = "crane berth pilot tugboat lantern anchor ballast quay rudder manifest".split()


def drawn(rnd, n, most=3):
    """Lines with a probability each: ``(line, p)``."""
    out = []
    for k in range(n):
        words = rnd.sample(HARBOUR, rnd.randrange(1, most + 1))
        p = rnd.choice([0.05, 0.2, 0.31, 0.5, 0.69, 0.8, 0.95])
        out.append((f"{' '.join(words)} #{k} p={p}", p))
    return out


def loaded(spark, *files, mode="lines"):
    return R.from_strings(spark, ["".join(x + R.SEPARATORS[mode] for x in f) for f in files], mode)


def model(p, threshold=0.5, band=None, invert=False):
    if band:
        lo, hi = band
        return "uncertain" if lo <= p <= hi else "selected" if (p > hi) != invert else "rejected"
    return "selected" if (p >= threshold) != invert else "rejected"


SETTINGS = [{}, {"invert": True}, {"threshold": 0.69}, {"threshold": 0.0}, {"band": (0.31, 0.69)}, {"band": (0.2, 0.2), "invert": True}, {"band": (0.0, 1.0)}]


@pytest.mark.parametrize("kw", SETTINGS, ids=str)
def test_verdicts(spark, kw):
    rnd = random.Random(str(kw))
    files = [drawn(rnd, 17), drawn(rnd, 1), []]
    got = filt.sem_filter(loaded(spark, *[[t for t, _ in f] for f in files]), O.default_oracle(), "speaks of a berth", **kw)
    want = [(i, k, model(p, **kw)) for i, f in enumerate(files) for k, (_, p) in enumerate(f, 1)]
    assert [(r["file_idx"], r["num"], r["verdict"]) for r in got.orderBy("file_idx", "num").collect()] == want
    counts = filt.totals(got).collect()[0].asDict()
    assert counts == {v: sum(w[2] == v for w in want) for v in ("selected", "rejected", "uncertain", "failed")}
    first = [w for w in want if w[2] == "selected"][:4]
    assert [(r["file_idx"], r["num"], r["verdict"]) for r in filt.selected(got, limit=4).collect()] == first


@pytest.mark.parametrize("before, after", [(0, 0), (1, 2), (3, 0)])
def test_context_of_matches(spark, before, after):
    rnd = random.Random(before * 10 + after)
    lines = drawn(rnd, 40)
    judged = filt.sem_filter(loaded(spark, [t for t, _ in lines]), O.default_oracle(), "q", threshold=0.8)
    hits = [k for k, (_, p) in enumerate(lines, 1) if p >= 0.8]
    shown = sorted({k for h in hits for k in range(h - before, h + after + 1) if 1 <= k <= len(lines)})
    got = filt.with_context(judged, before, after).orderBy("num").collect()
    assert [(r["num"], r["match"]) for r in got] == [(k, k in hits) for k in shown]
    assert [r["num"] for r in got if r["gap"]] == [k for j, k in enumerate(shown) if j and shown[j - 1] != k - 1]
    if hits:
        cut = filt.with_context(judged, before, after, limit=1).orderBy("num").collect()
        assert [r["num"] for r in cut] == [k for k in range(hits[0] - before, hits[0] + after + 1) if 1 <= k <= len(lines)]
        assert all((r["p"] is None) == (r["num"] > hits[0]) for r in cut)


def test_printed_context(spark):
    judged = filt.sem_filter(loaded(spark, ["fog p=0.9", "calm p=0.1", "swell p=0.1", "gale p=0.9"]), O.default_oracle(), "q")
    rows = filt.with_context(judged, 0, 0).orderBy("num").collect()
    assert "".join(render.records(rows, numbers=True, scores=True)) == "0.90\t1:fog p=0.9\n--\n0.90\t4:gale p=0.9\n"
    last = filt.with_context(judged, 0, 2, limit=1).orderBy("num").collect()
    assert "".join(render.records(last, numbers=True, scores=True)) == "0.90\t1:fog p=0.9\n-\t2-calm p=0.1\n-\t3-swell p=0.1\n"


@pytest.mark.parametrize("mode", ["lines", "nul", "para"])
def test_record_modes_come_back(spark, mode):
    rnd = random.Random(mode)
    texts = ["\n".join(t for t, _ in drawn(rnd, rnd.choice([1, 2]))) if mode != "lines" else drawn(rnd, 1)[0][0] for _ in range(12)]
    got = filt.sem_filter(loaded(spark, texts, mode=mode), O.default_oracle(), "q", threshold=0.0).orderBy("num").collect()
    assert [r["text"] for r in got] == texts
    assert "".join(render.records(got, mode)) == "".join(t + R.SEPARATORS[mode] for t in texts)


def test_fields_and_their_checks(spark):
    rows = [("berth", "p=0.9"), ("quay", "p=0.1"), ("alone",)]
    got = filt.sem_filter(loaded(spark, [";".join(r) for r in rows]), O.default_oracle(), "Does {2} follow from {1}?", delimiter=";").orderBy("num").collect()
    assert [r["p"] for r in got] == [0.9, 0.1, 0.05]
    for query in ("what of {3}?", "{0} or {1}"):
        with pytest.raises(ValueError):
            filt.sem_filter(loaded(spark, ["x"]), O.default_oracle(), query)


def test_files_by_their_best_chunk(spark):
    rnd = random.Random(5)
    texts = ["".join(t + "\n" for t, _ in drawn(rnd, 30)) for _ in range(4)] + [""]
    df = spark.createDataFrame([(i, f"log{i}", t) for i, t in enumerate(texts)], "file_idx int, file string, text string")
    chunks = R.chunked(df, 60)
    pieces = chunks.orderBy("file_idx", "chunk").collect()
    assert ["".join(c["text"] for c in pieces if c["file_idx"] == i) for i in range(5)] == texts
    got = filt.sem_filter_files(chunks, O.default_oracle(), "tells of a pilot", threshold=0.9).orderBy("file_idx").collect()
    for i, r in enumerate(got):
        first = [re.search(r"p=([\d.]+)", c["text"]) for c in pieces if c["file_idx"] == i]
        assert r["p"] == max(float(m[1]) if m else 0.05 for m in first)
        assert r["verdict"] == ("selected" if r["p"] >= 0.9 else "rejected")
    counted = filt.count_per_file(filt.sem_filter(R.records_of(df), O.default_oracle(), "q"), df).orderBy("file_idx").collect()
    assert [r["n"] for r in counted] == [sum(float(m) >= 0.5 for m in re.findall(r"p=([\d.]+)", t)) for t in texts]


@pytest.mark.parametrize("combine", ["any", "all", "mean"])
def test_one_answer_for_an_input(spark, combine):
    rnd = random.Random(combine)
    files = [drawn(rnd, n) for n in (1, 4, 9)]
    fold = {"any": max, "all": min, "mean": lambda x: sum(x) / len(x)}[combine]
    got = whole.sem_test(loaded(spark, *[[t for t, _ in f] for f in files]), O.default_oracle(), "Is all well?", combine=combine, group=["file_idx"]).orderBy("file_idx").collect()
    for f, r in zip(files, got):
        p = fold([x for _, x in f])
        assert r["p"] == pytest.approx(p) and r["verdict"] == ("yes" if p >= 0.5 else "no")
    assert whole.sem_test(loaded(spark, ["   ", "\t"]), O.default_oracle(), "?", combine=combine).collect()[0]["verdict"] == "error"
    doubt = whole.sem_test(loaded(spark, ["p=0.4"]), O.default_oracle(), "?", combine=combine, band=(0.35, 0.45), invert=True)
    assert doubt.collect()[0]["verdict"] == "uncertain"


def test_choice_and_its_distribution(spark):
    options = parse_labels(["cargo=what is carried", "crew", "weather"])
    one = spark.createDataFrame([(0, "the crew signed off")], "file_idx int, text string")
    got = whole.sem_choose(one, O.default_oracle(), options)
    assert (got.collect()[0]["label"], got.collect()[0]["verdict"]) == ("crew", "yes")
    spread = whole.distribution(got, [o.name for o in options]).orderBy("place").collect()
    assert [r["label"] for r in spread] == ["crew", "cargo", "weather"] and sum(r["p"] for r in spread) == pytest.approx(1)
    nothing = spark.createDataFrame([(0, "dredging")], "file_idx int, text string")
    assert whole.sem_choose(nothing, O.keyword_oracle(), options, other="none of these").collect()[0]["verdict"] == "no"


def named(line, names, fallback):
    return next((n for n in names if n in line), fallback)


@pytest.mark.parametrize("kw", [{}, {"threshold": 0.5}, {"other": "elsewhere"}, {"threshold": 0.5, "unsure": "??"}], ids=str)
def test_labels(spark, kw):
    rnd = random.Random(str(kw))
    names = ["anchor", "rudder", "pilot"]
    lines = [t + rnd.choice(["", " unsure"]) for t, _ in drawn(rnd, 60)]
    got = label.sem_label(loaded(spark, lines), O.keyword_oracle(), [Label(n) for n in names], **kw)
    options = names + ([kw["other"]] if "other" in kw else [])
    want = [kw.get("unsure", "?") if "unsure" in t and kw.get("threshold") else named(t, options, options[-1]) for t in lines]
    assert [r["label"] for r in got.orderBy("num").collect()] == want
    order = list(dict.fromkeys(want))
    assert [(r["label"], r["n"]) for r in label.label_counts(got).orderBy("place").collect()] == [(x, want.count(x)) for x in order]
    kept = label.sem_label(loaded(spark, lines), O.keyword_oracle(), [Label(n) for n in names], only=order[:1], **kw)
    assert [r["num"] for r in kept.orderBy("num").collect()] == [k for k, w in enumerate(want, 1) if w == order[0]]


def test_routed_labels_nest(spark, tmp_path):
    rows = [("deck/stern", "a"), ("deck/stern", "b"), ("deck", "c"), ("hold/../x", "d"), ("!", "lost"), ("/", "e")]
    label.route(spark.createDataFrame(rows, "label string, text string"), str(tmp_path / "out"))
    found = {}
    for f in (tmp_path / "out").rglob("*.txt"):
        key = "/".join(p.split("=", 1)[1] for p in f.relative_to(tmp_path / "out").parts[:-1])
        found.setdefault(key, []).extend(f.read_text().split())
    assert {k: sorted(v) for k, v in found.items()} == {"deck/stern": ["a", "b"], "deck": ["c"], "hold/_/x": ["d"], "_/_": ["e"]}


VESSELS = "sail\n  one mast=small\n    sloop\n    cutter\n  two masts\n    ketch\n    yawl\nmotor\n  tug\n  ferry=carries cars\n    chain\nrowing\n"


def walked(text, nodes, beam):
    """Every path with the product of its probabilities, best by the geometric mean; choices of one cost nothing."""
    live, done = [(nodes, "", 0.0, 0, ())], []
    while live:
        grown = []
        for kids, path, logp, n, place in live:
            hits = [i for i, k in enumerate(kids) if k.name in text]
            won = hits[0] if hits else len(kids) - 1
            for i, k in enumerate(kids):
                p = 1.0 if len(kids) == 1 else 0.9 if i == won else 0.1 / (len(kids) - 1)
                item = (k.children, f"{path}/{k.name}".strip("/"), logp + (math.log(p) if len(kids) > 1 else 0), n + (len(kids) > 1), place + (i,))
                grown.append(item)
        key = lambda x: (-(x[2] / x[3] if x[3] else 0), x[4])
        both = sorted(grown + done, key=key)[:beam]
        live, done = [x for x in both if x[0]], [x for x in both if not x[0]]
    best = min(done, key=lambda x: (-(x[2] / x[3] if x[3] else 0), x[4]))
    return best[1], math.exp(best[2] / best[3]) if best[3] else 1.0


@pytest.mark.parametrize("beam", [1, 2, 5])
def test_taxonomy(spark, beam):
    roots = parse_taxonomy(VESSELS)
    lines = ["sail two masts yawl", "motor ferry at noon", "rowing regatta", "sail one mast", "nothing that fits", "cutter", "tug and sail"]
    got = label.sem_label_tree(loaded(spark, lines), keyword_options("last"), roots, beam=beam).orderBy("num").collect()
    for line, r in zip(lines, got):
        want = walked(line, roots, beam)
        assert r["label"] == want[0] and r["confidence"] == pytest.approx(want[1])
    with pytest.raises(ValueError):
        parse_taxonomy("hull\n  keel\n  keel\n")


def test_ranking(spark):
    rnd = random.Random(8)
    lines = drawn(rnd, 30)
    for reverse, top in itertools.product([False, True], [None, 7]):
        want = sorted(range(30), key=lambda k: (lines[k][1] if reverse else -lines[k][1], k))[:top]
        got = rank.sem_rank(loaded(spark, [t for t, _ in lines]), O.default_oracle(), "q", reverse=reverse, top=top).collect()
        assert [r["num"] - 1 for r in got] == want
    levels = rank.sem_rank(loaded(spark, ["level=2", "level=0", "no level", "level=9"]), O.default_oracle(), "how rough", levels=["calm", "choppy", "stormy"]).collect()
    assert [(r["num"], r["score"]) for r in levels] == [(1, 2.0), (3, 1.0), (4, 1.0), (2, 0.0)]


def passes_of(values, n):
    """The odd-even passes over a list seeded by five levels."""
    now = sorted(values, key=lambda v: min(4, v // 5))
    quiet = 0
    for k in range(n):
        swapped = False
        for i in range(k % 2, len(now) - 1, 2):
            if now[i] >= now[i + 1]:  # not sure to come before
                now[i], now[i + 1], swapped = now[i + 1], now[i], True
        quiet = 0 if swapped else quiet + 1
        if quiet == 2:
            break
    return now


@pytest.mark.parametrize("n, passes", [(23, 0), (23, 1), (23, 4), (24, 40), (2, 3), (1, 3)])
def test_sorting(spark, n, passes):
    values = random.Random(n + passes).sample(range(n), n)
    df = loaded(spark, [f"buoy {v}" for v in values])
    got = [int(r["text"].split()[1]) for r in sort.sem_sort(df, O.number_order(), "by number", passes=passes).collect()]
    assert got == passes_of(values, passes)
    if passes == 40:
        back = sort.sem_sort(df, O.number_order(), "by number", passes=passes, reverse=True, limit=5).collect()
        assert [int(r["text"].split()[1]) for r in back] == list(range(n - 1, n - 6, -1))


@pytest.mark.parametrize("keep", ["first", "repeated", "unique", "all"])
def test_runs(spark, keep):
    rnd = random.Random(keep)
    lines = [f"{rnd.choice(HARBOUR[:3])} {k}" for k in range(50)]
    groups = [list(g) for _, g in itertools.groupby(enumerate(lines, 1), key=lambda x: x[1].split()[0])]
    got = collapse.sem_collapse(loaded(spark, lines), O.same_first_word(), keep=keep).orderBy("num").collect()
    if keep == "all":
        assert [r["num"] for r in got] == [k for g in groups if len(g) > 1 for k, _ in g]
        return
    kept = [g for g in groups if {"first": True, "repeated": len(g) > 1, "unique": len(g) == 1}[keep]]
    assert [(r["num"], r["n"], r["text"]) for r in got] == [(g[0][0], len(g), g[0][1]) for g in kept]
    assert "".join(render.runs(got, counts=True)) == "".join(f"{len(g):7d} {g[0][1]}\n" for g in kept)


@pytest.mark.parametrize("least", [1, 2, 5])
def test_segments(spark, least):
    rnd = random.Random(least)
    lines = [rnd.choice(["NEW watch", "entry", "remark", "p=0.7", "p=0.4"]) for _ in range(60)]
    got = segment.sem_segment(loaded(spark, lines), O.new_marker(), min_len=least, threshold=0.6).orderBy("num").collect()
    since, seg, shown = 0, 1, []
    for k, (line, r) in enumerate(zip(lines, got)):
        fits = k > 0 and ("NEW" in line or line == "p=0.7")
        if fits and since >= least:
            seg, since = seg + 1, 0
            shown.append("")
        since += 1
        shown.append(line)
        assert (r["segment"], r["cut"]) == (seg, since == 1 and k > 0)
    assert "".join(render.segmented(got)) == "".join(x + "\n" for x in shown)


WRAPS = [
    (["Slack water came", "at four bells."], {}, ["Slack water came at four bells."]),
    (["Moored.", "Then rain."], {}, ["Moored.", "Then rain."]),
    (["tide table", "", "next entry", "goes on"], {}, ["tide table", "", "next entry goes on"]),
    (["~~~", "raw text", "raw too", "~~~", "outside", "and on"], {}, ["~~~", "raw text", "raw too", "~~~", "outside and on"]),
    (["3) hoist", "4) lower", "   slowly"], {}, ["3) hoist", "4) lower slowly"]),
    (["## Log", "first line", "***", "after rule"], {}, ["## Log", "first line", "***", "after rule"]),
    (["| h | v |", "| 1 | 2 |", "below"], {}, ["| h | v |", "| 1 | 2 |", "below"]),
    (["see:", "\tindented()", "done"], {}, ["see:", "\tindented()", "done"]),
    (["> said he", "> and more", "plain"], {}, ["> said he and more plain"]),
    (["no stop", "p=0.2 here"], {}, ["no stop p=0.2 here"]),
    (["a stop.", "p=0.49 here"], {}, ["a stop.", "p=0.49 here"]),
    (["no stop", "p=0.5 x"], {"dangling": 0.6}, ["no stop", "p=0.5 x"]),
    (["ropes", "knots"], {"separator": "+"}, ["ropes+knots"]),
    (["star-", "board"], {"dehyphen": True}, ["starboard"]),
    (["star-", "Board"], {"dehyphen": True}, ["star-", "Board"]),
    (["star-", "board"], {}, ["star- board"]),
]


def test_wrapped_lines(spark):
    for kw in {str(k): k for _, k, _ in WRAPS}.values():
        cases = [(a, b) for a, k, b in WRAPS if k == kw]
        got = unwrap.sem_unwrap(loaded(spark, *[a for a, _ in cases]), O.lowercase_start(), **kw).orderBy("file_idx", "num").collect()
        for i, (_, want) in enumerate(cases):
            assert [r["text"] for r in got if r["file_idx"] == i] == want


def test_best_record(spark):
    rnd = random.Random(12)
    lines = [rnd.choice(["", "chart", "ANSWER buoy", "PARTIAL", "UNSURE"]) + (f" {k}" if rnd.random() < 0.9 else "") for k in range(700)]
    value = lambda t: 0.9 if "ANSWER" in t else 0.6 if "PARTIAL" in t else 0.3 if "UNSURE" in t else 0.01
    want = sorted((k for k, t in enumerate(lines) if t.strip()), key=lambda k: (-value(lines[k]), k))[:4]
    for window, tokens in ((255, 16_000), (16, 16_000), (255, 40)):
        got = pick.sem_pick(loaded(spark, lines), O.answer_marker(), "where?", best=4, window=window, tokens=tokens).orderBy("place").collect()
        assert [r["num"] - 1 for r in got] == want
    none = loaded(spark, ["chart", "map"])
    assert pick.sem_pick(none, O.answer_marker(), "where?").count() == 0 and pick.sem_pick(none, O.answer_marker(), "where?", force=True).count() == 1


def test_windows_are_filled_in_order(spark):
    rnd = random.Random(13)
    lines = ["word " * rnd.choice([1, 5, 30, 90]) for _ in range(300)]
    sizes = [r["e"] for r in loaded(spark, lines).orderBy("num").select(estimate(F.col("text")).alias("e")).collect()]
    want, used = [], None
    for e in sizes:
        if used is None or want[-1] >= 20 or used + e > 60 or e > 60:
            want.append(0)
            used = 0
        want[-1] += 1
        used = None if e > 60 else used + e
    got = pick.windows_of(loaded(spark, lines), window=20, tokens=60).orderBy("window").collect()
    assert [r["n"] for r in got] == want


def test_best_match(spark):
    text = "berth 12, berth 7\nANSWER berth 31\nberth 12"
    df = spark.createDataFrame([(0, text)], "file_idx int, text string")
    found = pick.candidates(df, [r"berth \d+", r"\d+"]).orderBy("start", "span").collect()
    assert [(r["span"], r["line"]) for r in found] == [("berth 12", 1), ("12", 1), ("berth 7", 1), ("7", 1), ("berth 31", 2), ("31", 2)]
    best = pick.sem_pick_match(df, O.answer_marker(), [r"berth \d+"], "which?").collect()
    assert [(r["span"], r["line"], r["verdict"]) for r in best] == [("berth 31", 2, "yes")]


def edited(text, pattern, new, acts):
    out = []
    for line in re.split("(?<=\n)", text):
        out.append(re.sub(pattern, new, line) if acts(line) else line)
    return "".join(out)


@pytest.mark.parametrize(
    "kw, pattern, new",
    [
        ({"action": "translate", "set1": "kq", "set2": "KQ"}, "[kq]+", lambda m: m[0].upper()),
        ({"action": "translate", "set1": "aiou", "set2": "_"}, "[aiou]+", lambda m: "_" * len(m[0])),
        ({"action": "squeeze", "set1": "-="}, r"(-){2,}|(=){2,}", lambda m: m[0][0]),
        ({"action": "delete", "set1": "[:digit:]"}, r"\d+", ""),
        ({"action": "delete", "patterns": [r"\s*#\d+"]}, r"\s*#\d+", ""),
        ({"patterns": [r"(\w+)@(\w+)"], "template": "$2 at ${1}"}, r"(\w+)@(\w+)", r"\2 at \1"),
    ],
    ids=str,
)
def test_edits(spark, kw, pattern, new):
    rnd = random.Random(str(kw)[:30])
    texts = ["".join(rnd.choice(["yes ", "no "]) + rnd.choice(["quay--7==2", "pilot@dock #4", "rock   #12", "-----", "kiosk9"]) + rnd.choice(["\n", "\r\n"]) for _ in range(8)) + "yes quick@end" for _ in range(6)] + [""]
    df = spark.createDataFrame(list(enumerate(texts)), "file_idx int, text string")
    got, trace = edit.sem_edit(df, O.default_oracle(), "stands in a line that says yes", **kw)
    want = [edited(t, pattern, new, lambda line: "yes" in line) for t in texts]
    assert [r["text"] for r in got.orderBy("file_idx").collect()] == want
    for r in trace.collect():
        line = texts[r["file_idx"]].split("\n")[r["line"] - 1]
        assert line[r["col"] - 1 :].startswith(r["occ"].split("\n")[0]) and r["acted"] == ("yes" in line)


def test_choosing_a_replacement(spark):
    text = "left: turn P\nright: turn P\nturn P\n"
    df = spark.createDataFrame([(0, text)], "file_idx int, text string")
    got, trace = edit.sem_edit(df, O.default_oracle(), "sides", action="choose", patterns=[r"\bP\b"], options=["left", "right"])
    assert got.collect()[0]["text"] == "left: turn left\nright: turn right\nturn P\n"
    assert [r["choice"] for r in trace.orderBy("start").collect()][:2] == ["left", "right"]
    for bad in (["a", "a"], ["keep", "b"], ["only"], ["", "b"]):
        with pytest.raises(ValueError):
            edit.sem_edit(df, O.default_oracle(), "q", action="choose", patterns=["P"], options=bad)
    for bad in ({"action": "delete", "patterns": ["(?<!a)P"]}, {"action": "translate", "set1": "a"}, {}):
        with pytest.raises(ValueError):
            edit.sem_edit(df, O.default_oracle(), "q", **bad)


@pytest.mark.parametrize("n, at, invert", [(1, 0, False), (40, 40, False), (500, 317, False), (500, 0, False), (700, 255, True), (17, 16, False)])
def test_flips(spark, n, at, invert):
    lines = [f"sounding {k} p={0.9 if (k >= at) != invert else 0.1}" for k in range(n)]
    flip, rows = bisect.sem_bisect(loaded(spark, lines), O.default_oracle(), "is after", invert=invert, verify=True)
    assert flip.pos == (None if at == n else at) and flip.verdict == ("no" if at == n else "yes") and flip.already == (at == 0)
    most, span = 1, n
    while span > bisect.PROBES:
        most, span = most + 1, span / (bisect.PROBES + 1)
    assert len(flip.rounds) <= most and flip.questions <= most * bisect.PROBES + 2
    shown = bisect.around(rows, flip, 2, 1).orderBy("pos").collect()
    assert [r["pos"] for r in shown] == ([] if at == n else [k for k in range(at - 2, at + 2) if 0 <= k < n])


def test_flip_in_doubt(spark):
    bumpy = [f"mark {k} p={0.95 if 60 <= k < 70 or k >= 300 else 0.05}" for k in range(400)]
    flip, _ = bisect.sem_bisect(loaded(spark, bumpy), O.default_oracle(), "q", k=40)
    assert flip.pos == 60 and flip.inversions
    vague = [f"mark {k} p={0.1 if k < 90 else 0.5 if k == 90 else 0.9}" for k in range(180)]
    flip, _ = bisect.sem_bisect(loaded(spark, vague), O.default_oracle(), "q", band=(0.4, 0.6))
    assert flip.pos == 91 and flip.verdict == "uncertain"
    assert bisect.sem_bisect(loaded(spark, []), O.default_oracle(), "q")[0].pos is None


def test_questions_as_columns(spark):
    specs = parse_specs(["wet: is it wet", "part: which part [bow|mast=the tall one|keel]", "how old <new|worn|rotten>"])
    got = probe.sem_probe(loaded(spark, ["yes the mast level=1", "keel level=2", "hm"]), O.default_oracle(), specs, scores=True).orderBy("num").collect()
    assert [(r["wet"], r["part"], r["part.conf"], r["q3"]) for r in got] == [(0.95, "mast", 0.8, 1.0), (0.05, "keel", 0.8, 2.0), (0.05, "bow", 0.0, 1.0)]
    text = probe.as_json(probe.sem_probe(loaded(spark, ["yes"]), O.default_oracle(), specs[:1]), specs[:1]).collect()[0]["json"]
    assert text == '{"record":"yes","answers":{"wet":0.95}}'
    with pytest.raises(ValueError):
        probe.sem_probe(loaded(spark, ["x"]), O.default_oracle(), parse_specs(["num: taken"]))


def test_columns_by_meaning(spark):
    ships = spark.createDataFrame([("Ada", 3, "red"), ("Bea", 5, None)], "Ship string, Masts int, Hull string")
    verdict, got = columns.sem_columns(ships, columns.header_oracle(), ["colour of the hull", "which ship", "again the hull"])
    assert verdict == "yes" and got.columns == ["Hull", "Ship", "Hull_2"] and got.collect()[0]["Hull_2"] == "red"
    assert columns.sem_columns(ships, columns.header_oracle(), ["masts", "price"])[0] == "no"
    assert columns.sem_columns(ships, columns.header_oracle(), ["unsure masts"])[0] == "uncertain"
    ragged = spark.createDataFrame([(["1", "2", "3"],), ([],), (["4"],)], "cells array<string>")
    assert [r["cells"] for r in columns.project_cells(ragged, [1, 1, 0]).collect()] == [["2", "2", "1"], ["", "", ""], ["", "", "4"]]


STORES = [f"{d}/{f}" for d in ("hold/fore", "hold/aft", "bridge") for f in ("list.txt", "plan.svg")] + ["keys.csv", "a/b/c/d/lone.md"]


@pytest.mark.parametrize(
    "query, kw, want",
    [
        ("hold aft plan.svg", {}, "hold/aft/plan.svg"), ("bridge HERE", {}, "bridge"), ("hold fore", {"dirs_only": True}, "hold/fore"), ("keys.csv", {"files_only": True}, "keys.csv"),
        ("a b c d lone.md", {}, "a/b/c/d/lone.md"), ("submarine", {}, None), ("hold aft plan.svg", {"least": 0.97}, None), ("bridge list.txt", {"verify": walk.path_words()}, "bridge/list.txt"),
    ],
)
def test_walks(spark, query, kw, want):
    nodes = T.nodes_of_paths(spark.createDataFrame([(p,) for p in STORES], "path string"))
    got = [r["path"] for r in walk.sem_walk(nodes, walk.path_words(), query, **kw).orderBy("place").collect()]
    assert got == ([] if want is None else [want])


def test_large_and_scanned_directories(spark, tmp_path):
    many = T.nodes_of_paths(spark.createDataFrame([(f"sheet{i}.pdf",) for i in range(260)], "path string"))
    got = walk.sem_walk(many, walk.path_words(), "sheet77.pdf").collect()
    assert got[0]["path"] == "sheet77.pdf" and got[0]["score"] == pytest.approx(0.95)
    odd = T.nodes_of_paths(spark.createDataFrame([(p,) for p in ("./x/y.txt", "x/../z", "/abs/q", "", "x/", "  ")], "path string"))
    assert {r["path"]: (r["is_dir"], r["files"]) for r in odd.collect()} == {"x": (True, 1), "x/y.txt": (False, 1), "abs": (True, 1), "abs/q": (False, 1)}
    for p in [*STORES, ".cache/seen", "hold/node_modules/m.js"]:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("")
    files = {r["path"] for r in T.read_directory(spark, str(tmp_path)).where("not is_dir").collect()}
    assert files == set(STORES)
    assert T.read_directory(spark, str(tmp_path), hidden=True).where("not is_dir").count() == len(STORES) + 2
    with pytest.raises(ValueError):
        T.read_directory(spark, str(tmp_path), most=5)


def test_walk_shows_what_lies_beneath(spark):
    """A judge by requests finds a directory with an unspeaking name by the names beneath it, and is shown the content at the end."""
    from semframe.plans.judge import BatchJudge

    def handler(request):
        out = []
        for q in request["questions"]:
            about = q["instructions"]
            if q["type"] == "choice":
                options = about["options"] if isinstance(about["options"], list) else json.loads(about["options"])
                fits = [o["option"] for o in options if "tide" in o["option"] or "tide" in (o.get("means") or "")] or ["(none)"]
                out.append({"probabilities": {o["option"]: float(o["option"] == fits[0]) for o in options}})
            else:
                out.append({"noul": 0.9 if "moon" in (about.get("content") or "") else 0.1})
        return out

    nodes = T.nodes_of_paths(spark.createDataFrame([(p,) for p in ("x1/a/tides.csv", "x1/b.txt", "x2/c.txt", "x2/d.txt")], "path string"))
    heads = spark.createDataFrame([("x1/a/tides.csv", "moon, height")], "path string, head string")
    got = walk.sem_walk(nodes, BatchJudge(handler), "tide tables", verify=BatchJudge(handler), heads=heads).collect()
    assert [(r["path"], r["score"]) for r in got] == [("x1/a/tides.csv", 0.9)]
    small = T.nodes_of_paths(spark.createDataFrame([(f"d/{c}/{i}.txt",) for c in "ab" for i in range(30)], "path string"))
    names = walk.names_beneath(small, small.where("path = 'd'"), F.lit(5)).collect()[0]["names"]
    assert names == ["a", "b", "a/0.txt", "a/1.txt", "a/10.txt"]


def test_heads_are_bounded(spark):
    df = loaded(spark, ["word " * 200] * 9, ["short"] * 30)
    got = R.head_of(df, 20, 120, tokens=100).groupBy("file_idx").agg(F.count("num").alias("n"), F.max(F.length("text")).alias("w")).orderBy("file_idx").collect()
    per = R.head_of(df, 1, 120).where("file_idx = 0").select(estimate(F.col("text")).alias("e")).collect()[0]["e"]
    assert [(r["n"], r["w"]) for r in got] == [(100 // per, 120), (20, 5)]
