"""Packings and pieces against their rules, on random and odd inputs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from semframe.llm import packing, splitting


def check(lens, counts, cap):
    rows = packing.pack_histogram(lens, counts, cap)
    load, seen = {}, {x: set() for x in lens}
    for length, first, many, b, per in rows:
        for k in range(many):
            assert first + k not in seen[length]
            seen[length].add(first + k)
            load[b + k // per] = load.get(b + k // per, 0) + length
    assert all(seen[x] == set(range(n)) for x, n in zip(lens, counts))
    assert all(v <= cap for v in load.values())
    return len(load)


def test_histograms():
    rnd, ours, theirs = random.Random(5), 0, 0
    for _ in range(150):
        cap = rnd.choice([10, 97, 1000, 7360])
        lens = sorted({rnd.randrange(0, cap + 1) if rnd.random() < 0.2 else min(cap, int(rnd.expovariate(8 / cap)) + 1) for _ in range(rnd.randrange(1, 60))})
        rnd.shuffle(lens)
        counts = [rnd.choice([1, 1, 2, 9, 30]) for _ in lens]
        n = check(lens, counts, cap)
        rooms = []  # first fit decreasing, one by one
        for x in sorted((x for x, c in zip(lens, counts) for _ in range(c)), reverse=True):
            k = next((k for k, room in enumerate(rooms) if room >= x), None)
            if k is None:
                rooms.append(cap - x)
            else:
                rooms[k] -= x
        ours += n
        theirs += len(rooms)
        assert n <= 1.04 * len(rooms) + 1
    assert ours <= 1.005 * theirs
    assert check([5], [0], 10) == 0


def test_least_squares():
    cols = [((0, 2),), ((0, 1), (1, 1)), ((1, 3),)]
    x = packing.nnls(cols, [10, 4], sweeps=500)
    got = [2 * x[0] + x[1], x[1] + 3 * x[2]]
    assert min(x) >= 0 and abs(got[0] - 10) < 1e-2 and abs(got[1] - 4) < 1e-2


LIMITS = [("std", 100, 40, 2), ("compact", 50, 20, 1)]


def limits(spark):
    return spark.createDataFrame(LIMITS, "protocol string, ctx_total int, ctx_state_q int, overlap_lines int")


def test_assign(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["hot", "hot", "hot", f"s{i % 7}"]), rnd.randrange(1, 60)) for i in range(900)]
    rows = [(i, s, "std", 20, e) for i, s, e in rows]
    rows += rows[:20]  # repeated whole
    rows += [(2000, "hot", "std", 20, None), (2001, "hot", "std", 20, 333), (2002, "hot", "std", 20, 0), (2003, None, "std", 20, 5), (2004, "x", "nope", 20, 5), (2005, "full", "std", 100, 5), (2006, "neg", "std", 20, -4), (2007, "n", "std", None, 4)]
    items = spark.createDataFrame(rows, "item_id bigint, state_id string, protocol string, state_est int, est int").withColumn("len", F.lit("clash")).withColumn("status", F.lit(0))
    got = packing.assign(items, limits(spark)).collect()
    by = {}
    for r in got:
        by.setdefault(r["item_id"], []).append(r)
    assert set(by) == {r[0] for r in rows}
    for i, s, _, _, e in rows:
        if i < 2000:
            assert len(by[i]) == 1 and by[i][0]["part_est"] == e and by[i][0]["state_id"] == s
    assert sorted(r["part_est"] for r in by[2001]) == [13, 80, 80, 80, 80] and by[2001][0]["parts"] == 5
    assert by[2000][0]["status"] == by[2006][0]["status"] == "unknown_size" and by[2002][0]["status"] == "packed"
    assert {by[i][0]["status"] for i in (2003, 2004, 2005, 2007)} == {"no_room"}
    load = {}
    for r in got:
        if r["status"] == "packed":
            load.setdefault(r["request_id"], [r["state_id"], 20])
            assert load[r["request_id"]][0] == r["state_id"]
            load[r["request_id"]][1] += r["part_est"]
    assert max(x for _, x in load.values()) <= 100
    total = sum(r["part_est"] for r in got if r["status"] == "packed" and r["state_id"] == "hot")
    hot = sum(1 for s, _ in load.values() if s == "hot")
    assert hot <= 1.1 * total / 80 + 1
    req = {r["request_id"]: r["est"] for r in packing.requests(packing.assign(items, limits(spark))).collect()}
    assert all(req[k] == v[1] for k, v in load.items())
    assert packing.assign(items.limit(0), limits(spark)).count() == 0


def covers(lines, ests, limit, overlap):
    pieces = splitting.cut(lines, ests, limit, overlap)
    assert all(p["est"] <= limit for p in pieces)
    at, inside = 0, 0
    for k, p in enumerate(pieces):
        if p["start"] is None:
            assert inside == 0 and p["first"] + p["shared"] == at and p["shared"] <= overlap
            assert p["est"] == sum(ests[p["first"] : p["last"] + 1])
            at = p["last"] + 1
        else:
            assert p["first"] == p["last"] == at and p["start"] == inside
            inside = p["stop"]
            if inside == len(lines[at]):
                at, inside = at + 1, 0
    assert at == len(lines) and inside == 0
    return pieces


def test_cut_covers_everything():
    rnd = random.Random(2)
    kinds = ["# Head", "## Sub", "- item", "  - deeper", "plain text goes on. And on!", "", "", "```", "| a | b |", "1.2 Name", "中文。再来一句。" * 3, "x" * 400, "word " * 90]
    for _ in range(200):
        lines = [rnd.choice(kinds) for _ in range(rnd.randrange(1, 80))]
        ests = [splitting.estimate(x) for x in lines]
        covers(lines, ests, rnd.choice([8, 30, 100]), rnd.choice([0, 1, 3]))


def brute_overlap(pieces, ests, limit, overlap):
    """Whether every border between whole lines shares as many lines as fit beside the next line."""
    for a, b in zip(pieces, pieces[1:]):
        if a["start"] is not None or b["start"] is not None:
            continue
        new, most, size = b["first"] + b["shared"], 0, 0
        while most < overlap and new - most - 1 >= a["first"] and ests[new] + size + ests[new - most - 1] <= limit:
            most += 1
            size += ests[new - most]
        assert b["shared"] == most


def test_overlap_is_what_fits():
    pieces = covers(["x"] * 40, [60] * 40, 200, 2)
    assert all(p["shared"] == 2 for p in pieces[1:])
    rnd = random.Random(8)
    for _ in range(300):
        limit, overlap = rnd.choice([50, 200]), rnd.choice([1, 2, 5])
        lines = [rnd.choice(["# Head", "- item", "  - deep", "text", ""]) for _ in range(rnd.randrange(1, 60))]
        ests = [rnd.choice([1, limit // 5, limit // 3, limit // 2, limit]) for _ in lines]
        brute_overlap(covers(lines, ests, limit, overlap), ests, limit, overlap)


def test_deep_nesting_is_linear():
    lines = [" " * k + "- item" for k in range(4000)]
    assert len(covers(lines, [5] * 4000, 100, 1)) > 200
    lines = ["#" * (1 + k % 6) + " Head" for k in range(4000)]
    assert len(covers(lines, [5] * 4000, 100, 1)) > 200


def test_cut_keeps_sections_whole():
    lines = ["# A", ""] + ["alpha beta gamma."] * 4 + ["", "# B", ""] + ["delta epsilon."] * 4 + ["", "# C", ""] + ["zeta eta."] * 4
    ests = [10] * len(lines)
    pieces = covers(lines, ests, 140, 0)
    assert all(lines[p["first"]].startswith("#") for p in pieces) and len(pieces) == 2


def test_one_line_is_cut_at_sentences():
    line = "One sentence here. Another sentence there. " * 20
    pieces = covers([line], [splitting.estimate(line)], 30, 2)
    assert len(pieces) > 3 and all(line[p["start"] : p["stop"]].rstrip().endswith(".") for p in pieces)


def test_documents(spark):
    rows = [
        (1, "std", ["a"] * 10, [3] * 10), (2, "std", ["a"] * 20, [3] * 20), (3, "std", None, None), (4, "std", [], []), (5, None, ["a"] * 99, [9] * 99), (6, "nope", ["a"], [999]),
        (7, "std", ["word " * 100, None], [500, None]), (8, "std", ["abc"] * 5, None), (2, "std", ["a"] * 20, [3] * 20),
    ]
    docs = spark.createDataFrame(rows, "input_id bigint, protocol string, lines array<string>, line_est array<int>").withColumn("pieces", F.lit("clash")).withColumn("limit", F.lit(0))
    got = splitting.split_documents(docs, limits(spark))
    by = {}
    for r in got.collect():
        by.setdefault(r["input_id"], []).append(r)
    assert {r["input_id"] for r in splitting.oversized(got).collect()} == {2, 7}
    assert [len(by[i]) for i in (1, 3, 4, 5, 6, 8)] == [1] * 6 and by[3][0]["lines"] == [] and by[3][0]["est"] == 0
    assert all(r["est"] <= 40 for i in (2, 7) for r in by[i])
    two = sorted({(r["piece"], r["first_line"], r["last_line"], r["shared_lines"]) for r in by[2]})
    assert two[0][1] == 1 and two[-1][2] == 20 and all(x[3] == 2 for x in two[1:])
    assert splitting.split_documents(docs.limit(0), limits(spark)).count() == 0
