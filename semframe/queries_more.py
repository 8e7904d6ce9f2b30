"""Registered queries of sources, sinks, packed requests, traces and streams, each with the SQL that DuckDB answers alike."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import functions as F

from semframe.functions import text as T
from semframe.functions.templates import parse_question_json, parse_specs
from semframe import render
from semframe.operators import columns, edit, filter as filt, label, pick, probe, rank, segment, sort, test as whole, unwrap, walk
from semframe.plans import ledger, oracles as O, planner
from semframe.plans.judge import Ask, BatchJudge, Limits, Overlimit
from semframe.plans.remote import WaveJudge
from semframe.queries_ops import SQL as OPS
from semframe.queries_ops import _DOCS, _SPACE, _UNWRAP, _WRAPPED, LABELS, RULES, _clean_sql, _docs, _drained, _est_sql, _events, _inputs, _judge, _ledger, _p_sql, _stream, docs
from semframe.session import shared_folder, table
from semframe.sources import records as R
from semframe.sources import tables as TB
from semframe.sources import tree
from semframe.streaming import streams

# --- questions and requests --------------------------------------------------------------------------------------------
QUESTION = "reports a problem"


def by_rules(request: dict) -> list[dict]:
    """A handler by the rules of the expression judge: texts with ``review`` fail, choices take the first option named."""
    out = []
    for q in request["questions"]:
        said = q["instructions"]
        text = str(said.get("text") or "").lower()
        if "review" in text:
            out.append({"error": "no review"})
        elif q["type"] == "choice":
            won = next((o for o in q["criteria"] if o in text), None)
            out.append({"choice": won or next(iter(q["criteria"])), "confidence": 0.8 if won else 0.0})
        else:
            out.append({"noul": next((p for word, p in RULES if word in text), 0.05)})
    return out


def at_most(n: int):
    """The same, refusing requests of more than ``n`` questions as too large."""

    def handler(request: dict) -> list[dict]:
        if len(request["questions"]) > n:
            raise Overlimit(str(n))
        return by_rules(request)

    return handler


def by_document(request: dict) -> list[dict]:
    """A handler that reads the lines of a document by their ids: choices by the rules, segments where a line says ``signup``,
    joined lines by a small letter or a marker."""
    lines = dict(x.split("| ", 1) for x in request["state"]["document"].split("\n") if "| " in x)
    rule = lambda t: next((p for word, p in RULES if word in t.lower()), 0.05)
    out = []
    for q in request["questions"]:
        said = q["instructions"]["question"]
        tag = re.search(r"\b[LR]\d{4,}\b", said)
        if q["type"] == "choice":
            out.append({"probabilities": {k: rule(lines[k]) for k in q["criteria"]}})
        elif tag is None:
            out.append({"noul": max(map(rule, lines.values()))})
        elif tag[0][0] == "R":
            out.append({"noul": 0.95 if "signup" in lines[tag[0]] else 0.05})
        else:
            text = re.sub(r"\A[ \t>]+", "", lines[tag[0]])
            marker = re.search(r"p=([0-9]*\.?[0-9]+)", text)
            out.append({"noul": float(marker[1]) if marker else 0.9 if unicodedata.category(text[:1] or " ") == "Ll" else 0.05})
    return out


SMALL = Limits(request_tokens=4_000, question_tokens=1_000, questions=16)


def batch_filter(spark, d):
    """A filter by packed requests: failed records are neither selected nor rejected."""
    return filt.sem_filter(_docs(spark, d), BatchJudge(by_rules), QUESTION).select("doc_id", "p", "verdict", "error")


def batch_halves(spark, d):
    """Refused requests are asked in halves; a question too large for any request fails alone."""
    return filt.sem_filter(_docs(spark, d), BatchJudge(at_most(5), SMALL), QUESTION).select("doc_id", "p", "error")


def batch_label(spark, d):
    """Labels by packed requests: failed records are ``!``, unsure ones ``?``."""
    return label.sem_label(_docs(spark, d), BatchJudge(by_rules), LABELS, threshold=0.5).select("doc_id", "label", "confidence")


def batch_pick(spark, d):
    """The best records by choices among the lines of documents."""
    return pick.sem_pick(_inputs(spark, d), BatchJudge(by_document), "Which reports a problem?", best=2, group=["file"]).select("file", "place", "num", "p", "verdict")


def batch_segment(spark, d):
    """Segments, all boundaries of a window in one request."""
    return segment.segments(segment.sem_segment(_events(spark, d), BatchJudge(by_document), group=["user_id"], around=1), ["user_id"])


def batch_unwrap(spark, d):
    """Rejoined lines, all breaks of a window in one request."""
    return unwrap.sem_unwrap(_inputs(spark, d), BatchJudge(by_document), dehyphen=True, group=["file"])


def batch_rank(spark, d):
    out = rank.sem_rank(_docs(spark, d), BatchJudge(by_rules), QUESTION, ties=["doc_id"])
    return out.select("doc_id", "score", F.col("error").isNotNull().alias("failed"))


WAVE, BUDGET = 100, 60_000


def wave_budget(spark, d):
    """Two uses of one budget, in waves in order: every record comes back, the unasked ones marked."""
    x = _docs(spark, d).orderBy("doc_id")
    j = WaveJudge(BatchJudge(by_rules), rows_per_wave=WAVE, max_tokens=BUDGET)
    first = filt.sem_filter(x, j, QUESTION).select(F.lit(1).alias("use"), "doc_id", "p", "error")
    return first.unionByName(filt.sem_filter(x, j, QUESTION).select(F.lit(2).alias("use"), "doc_id", "p", "error"))


def wave_stop(spark, d):
    """After enough records no further wave is asked."""
    x = _docs(spark, d).orderBy("doc_id").withColumn("_text", F.coalesce(T.clean(F.col("text")), F.lit("")))
    j = WaveJudge(BatchJudge(by_rules), rows_per_wave=WAVE)
    out = j.attach_until(x, Ask("noul", QUESTION, {"text": F.col("_text")}), "a", F.col("a.noul") >= 0.5, 60)
    return out.select("doc_id", F.coalesce(F.col("a.error"), F.lit("")).alias("error"))


def questions_encoded(spark, d):
    """The questions as they are sent: neighbours, fields, criteria, estimate."""
    x = R.with_neighbours(docs(spark, d), 1, ["file"]).withColumn("_text", F.coalesce(T.clean(F.col("text")), F.lit("")))
    ask = Ask("noul", "Is it true that `text` reports a problem?", {"before": F.transform("before", T.clean), "text": F.col("_text"), "f2": F.lit("x")}, yes="It does", context={"about": "logs"})
    return x.select("doc_id", F.col("num").alias("place"), ask.instructions().alias("instructions"), F.lit(ask.criteria()).alias("criteria"), F.lit(ask.state()).alias("state"))


def questions_of_specs(spark, d):
    """Questions by the small language and by JSON, as an answer for each document."""
    specs = parse_specs(["topic: about [invoice=money|error|review]"]) + parse_question_json('{"bad": {"type": "noul", "instructions": "is it bad"}, "how": {"type": "score", "instructions": "how", "criteria": ["low", "high"]}}')
    x = table(spark, d, "documents").select("doc_id", "text").where(F.col("text").isNotNull())
    return whole.sem_ask(x, O.default_oracle(), specs).select("doc_id", "topic", F.round("bad", 6).alias("bad"), "how")


def tags(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.tagged_id("L", F.col("o_orderkey")).alias("tag"))


def windows_of_sources(spark, d):
    """Windows of a tournament: filled in order by count and tokens."""
    return pick.windows_of(docs(spark, d), ["file"], window=40, tokens=2_000).select("file", "window", "n")


# --- sources and sinks -------------------------------------------------------------------------------------------------
def lines_written(spark, d):
    """Lines written in order and read back by blocks, numbered; a file that is not there is told apart."""
    where = shared_folder(spark, "lines")
    x = table(spark, d, "orders").select(F.lit(0).alias("file_idx"), F.col("o_orderkey").cast("bigint").alias("num"), F.concat("o_orderpriority", F.lit(" "), F.col("o_orderkey").cast("string")).alias("text"))
    TB.write_records(x, where)
    missing = R.read_records(spark, [where, where + "-none"], missing="skip")[1]
    return R.read_lines(spark, [where]).select("num", "text", F.lit(len(missing)).alias("missing"))


def texts_written(spark, d):
    """Whole texts as NUL records, written and read back."""
    where = shared_folder(spark, "nul")
    x = docs(spark, d).where(F.col("text").isNotNull() & ~F.col("text").contains("\0") & (F.col("text") != "")).select(F.lit(0).alias("file_idx"), F.col("doc_id").alias("num"), "text")
    TB.write_records(x, where, "nul")
    return R.read_lines(spark, [where], R.NUL).select("num", F.length("text").alias("n"), F.md5("text").alias("md5"))


def whole_files(spark, d):
    """Records of several inputs by one read, each numbered by itself, in the order given; a file given twice is two inputs."""
    where = shared_folder(spark, "files")
    r = table(spark, d, "nation").select("n_regionkey", "n_nationkey", F.col("n_name").alias("value"))
    for k in (0, 1):
        r.where(F.col("n_regionkey") == k).orderBy("n_nationkey").select("value").coalesce(1).write.text(f"{where}/{k}")
    got, _ = R.read_records(spark, [f"{where}/1", f"{where}/0", f"{where}/1"])
    return got.where("file_idx in (0, 1, 2)").select("file_idx", "num", "text")


def chunks_of_texts(spark, d):
    """Chunks within a token budget that add up to the text."""
    x = table(spark, d, "documents").select(F.col("doc_id").cast("int").alias("file_idx"), F.col("file").cast("string").alias("file"), F.coalesce("text", F.lit("")).alias("text"))
    c = R.chunked(x, 150)
    return c.groupBy("file_idx").agg(F.sum(F.length("text")).alias("chars"), (F.max(T.estimate(F.col("text"))) <= 150).alias("within"))


def files_by_chunks(spark, d):
    """A filter of whole files by their best chunk."""
    x = table(spark, d, "documents").select(F.col("doc_id").cast("int").alias("file_idx"), F.col("doc_id").cast("string").alias("file"), F.coalesce("text", F.lit("")).alias("text"))
    return filt.sem_filter_files(R.chunked(x, 2_000), _judge(), "mentions an error").select(F.col("file_idx").alias("doc_id"), "p", "verdict")


def _table_written(spark, d, sep, name):
    where = shared_folder(spark, name)
    c = table(spark, d, "customer")
    cells = [F.col("c_custkey").cast("string"), F.concat(F.col("c_name"), F.lit(', "q"; x')) if sep != "\t" else F.col("c_name"), F.col("c_mktsegment")]
    rows = c.select(F.col("c_custkey").cast("bigint").alias("num"), F.lit(0).alias("file_idx"), F.array(*cells).alias("cells"))
    head = spark.createDataFrame([(-1, 0, ["key", "name", "segment"])], "num bigint, file_idx int, cells array<string>")
    full = head.unionByName(rows)
    TB.write_records(full.withColumn("text", TB.to_lines(full, sep)), where)
    header, got = TB.read_table(spark, where)
    return got.select(F.lit(",".join(header)).alias("header"), "num", F.col("cells")[0].alias("key"), F.col("cells")[1].alias("name"), F.col("cells")[2].alias("segment"))


def csv_written(spark, d):
    return _table_written(spark, d, ",", "csv")


def tsv_written(spark, d):
    return _table_written(spark, d, "\t", "tsv")


def csv_line_ends(spark, d):
    """Cells that hold line ends."""
    where = shared_folder(spark, "cells")
    c = table(spark, d, "supplier").select(F.concat_ws(",", F.col("s_suppkey").cast("string"), F.concat(F.lit('"'), F.col("s_name"), F.lit('\n""second"", line"'))).alias("value"), "s_suppkey")
    head = spark.createDataFrame([("key,name", -1)], "value string, s_suppkey bigint")
    head.unionByName(c.select("value", F.col("s_suppkey").cast("bigint").alias("s_suppkey"))).repartition(1).sortWithinPartitions("s_suppkey").select("value").write.text(where)
    header, got = TB.read_whole_table(spark, where)
    return got.select(F.lit(",".join(header)).alias("header"), F.col("cells")[0].alias("key"), F.col("cells")[1].alias("name"))


def routed_labels(spark, d):
    """Records routed to nested folders by label, read back."""
    where = shared_folder(spark, "route")
    x = _docs(spark, d).select("doc_id", F.col("doc_id").cast("string").alias("text"), F.concat(F.col("file"), F.lit("/"), F.pmod("doc_id", F.lit(3)).cast("string")).alias("label"))
    label.route(x, where)
    back = spark.read.option("recursiveFileLookup", "true").text(where).select("value", F.regexp_extract(F.col("_metadata.file_path"), "level1=([^/]*)/level2=([^/]*)/", 1).alias("one"), F.regexp_extract(F.col("_metadata.file_path"), "level1=([^/]*)/level2=([^/]*)/", 2).alias("two"))
    return back.groupBy("one", "two").agg(F.count(F.lit(1)).alias("n"))


def segments_written(spark, d):
    """Segments as folders, read back."""
    where = shared_folder(spark, "segments")
    x = segment.sem_segment(table(spark, d, "nation").select(F.lit(0).alias("file_idx"), (F.col("n_nationkey") + 1).cast("bigint").alias("num"), F.col("n_name").alias("text")), O.new_marker("I"))
    TB.write_segments(x, where)
    return spark.read.text(where).groupBy(F.col("segment").cast("int").alias("segment")).agg(F.count(F.lit(1)).alias("n"))


def ledger_file(spark, d):
    """A ledger written as its file and read back, malformed lines left out."""
    where = shared_folder(spark, "ledger")
    x = _ledger(spark, d).groupBy("day", "tool").agg(F.sum(F.col("usd").cast("decimal(24,6)")).alias("usd"), F.sum("tokens").alias("tokens"))
    lines = x.select(F.concat_ws("\t", F.date_format("day", "yyyy-MM-dd"), F.coalesce("tool", F.lit("")), F.col("usd").cast("string"), F.col("tokens").cast("string")).alias("value"))
    odd = spark.createDataFrame([("# day\ttool",), ("2026-13-01\tx\t1\t1",), ("2026-01-01\tx\t1",), ("2026-01-01\tx\tmany\t1",)], "value string")
    lines.unionByName(odd).write.text(where)
    return ledger.read_ledger(spark, where)


# --- matches and edits -------------------------------------------------------------------------------------------------
def _texts(spark, d):
    return table(spark, d, "documents").select("doc_id", "text").where(F.col("text").isNotNull())


MAIL = r"[a-z]+@[a-z]+\.example"


def match_candidates(spark, d):
    """The distinct matches of a text with their first place."""
    return pick.candidates(_texts(spark, d), [MAIL], ["doc_id"]).select("doc_id", "span", "line", "start")


def one_of_matches(request: dict) -> list[dict]:
    """A handler that chooses the first address of the bills among those offered by name or by id."""
    text = request["state"]["document"]
    out = []
    for q in request["questions"]:
        named = {k: (v or k) for k, v in q["criteria"].items()}
        won = next((k for k, v in named.items() if v.startswith("billing")), None)
        out.append({"probabilities": {k: 0.9 if k == won else 0.0 if won or k.startswith("(") or k == "none" else 0.6 for k in named}} if text else {"error": "no text"})
    return out


def batch_pick_match(spark, d):
    """The one match, by one choice among all the matches of a text."""
    return pick.sem_pick_match(_texts(spark, d), BatchJudge(one_of_matches), [MAIL], "Where do bills go?", key=["doc_id"], threshold=0.8).select("doc_id", "span", "line", "p", "verdict")


def edit_trace(spark, d):
    """Every occurrence with its place, whether it was acted on, and by what."""
    j = O.ExprJudge(lambda ask: O.answer(noul=F.when(F.col("line") % 2 == 1, 0.95).otherwise(0.05)))
    trace = edit.sem_edit(_texts(spark, d), j, "stands on an odd line", key=["doc_id"], patterns=[r"[0-9]{2,}"], template="<$0>")[1]
    return trace.select("doc_id", "line", "col", "occ", "p", "acted", "replacement")


def edit_union(spark, d):
    """Several patterns at once: leftmost, then longest, never overlapping."""
    j = O.ExprJudge(lambda ask: O.answer(noul=F.lit(0.95)))
    return edit.sem_edit(_texts(spark, d), j, "is a number", key=["doc_id"], action="delete", patterns=[r"[0-9]+", r"[A-Z]+-[0-9]+"])[0].select("doc_id", "text", "changed")


def edit_choose(spark, d):
    """One of two replacements for each occurrence, or none."""
    j = O.ExprJudge(None, lambda ask: O.answer(choice=F.when(F.col("line") % 3 == 0, "yes").when(F.col("line") % 3 == 1, "no").otherwise("keep"), confidence=F.lit(0.8)), None)
    return edit.sem_edit(_texts(spark, d), j, "parity", key=["doc_id"], action="choose", patterns=[r"[0-9]+"], options=["yes", "no"])[0].select("doc_id", "text")


def context_first(spark, d):
    """Context of the first matches only; what comes after the last of them was never judged."""
    judged = filt.sem_filter(docs(spark, d), _judge(), QUESTION, threshold=0.9)
    return filt.with_context(judged, before=1, after=2, limit=20, group=["file"]).select("file", "num", "p", "match")


# --- order -------------------------------------------------------------------------------------------------------------
def sort_suppliers(spark, d):
    """The seed of all suppliers, by levels of their number."""
    x = table(spark, d, "supplier").select(F.col("s_suppkey").cast("bigint").alias("num"), F.concat(F.lit("item "), F.pmod(F.col("s_suppkey") * 7 + 3, F.lit(25))).alias("text"))
    return sort.sem_sort(x, O.number_order(), "by number", passes=0, ties=["num"]).select("num", "pos", "seed")


def output_lines(spark, d):
    """Records with score, file and number before them, as they are written."""
    judged = filt.sem_filter(docs(spark, d), _judge(), QUESTION)
    return judged.select("doc_id", F.md5(render.line_column(files=True, numbers=True, scores=True, hit=F.col("p") >= 0.5)).alias("md5"))


def sort_reversed(spark, d):
    """The last of an order first."""
    x = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("num"), F.concat(F.lit("item "), F.pmod(F.col("n_nationkey") * 7 + 3, F.lit(25))).alias("text"))
    return sort.sem_sort(x, O.number_order(), "by number", passes=30, reverse=True, limit=5, ties=["num"]).select("num", "pos")


def pick_uncertain(spark, d):
    """Best records, those under a least probability uncertain."""
    return pick.sem_pick(docs(spark, d), _judge(), "Which reports a problem?", best=3, group=["file"], min_p=0.85).select("file", "place", "num", "verdict")


def columns_gate(spark, d):
    """What projections by description end with: sure, unsure, none."""
    c = table(spark, d, "customer")
    asked = {"sure": ["c_name"], "unsure": ["unsure c_name"], "none": ["c_name", "price"]}
    rows = [(k, *(lambda v, out: (v, len(out.columns)))(*columns.sem_columns(c, columns.header_oracle(), q))) for k, q in asked.items()]
    return spark.createDataFrame(rows, "asked string, verdict string, n int")


def columns_padded(spark, d):
    """Cells of ragged rows by place, short rows padded."""
    x = table(spark, d, "csv_rows").where(F.col("text").isNotNull()).select("file", "num", F.split("text", ",", -1).alias("cells"))
    return columns.project_cells(x, [7, 0]).select("file", "num", F.col("cells")[0].alias("eighth"), F.col("cells")[1].alias("first"))


def walk_gates(spark, d):
    """Places under a least score are left out; the verification sorts what is left."""
    nodes = tree.nodes_of_paths(table(spark, d, "documents").select(F.regexp_extract("file", "^[^/]*/[^/]*", 0).alias("path")))
    out = None
    for name, kw in (("kept", {"least": 0.85}), ("dropped", {"least": 0.95}), ("verified", {"verify": walk.path_words()})):
        one = walk.sem_walk(nodes, walk.path_words(), "memo p00", dirs_only=False, **kw).select(F.lit(name).alias("gate"), "path", F.round("score", 6).alias("score"))
        out = one if out is None else out.unionByName(one)
    return out


def quote_exact(spark, d):
    """A quote by the packer itself, under both ways of billing."""
    ask = Ask("noul", "Is it a problem?", {"text": F.coalesce(F.col("text"), F.lit(""))})
    rows = []
    for name, billing in (("state once", planner.Billing()), ("per question", planner.PerQuestion())):
        q = planner.plan(_docs(spark, d).orderBy("doc_id"), ask, exact=True, billing=billing)
        rows.append((name, q.questions, q.requests, q.tokens))
    return spark.createDataFrame(rows, "billing string, questions bigint, requests bigint, tokens bigint")


# --- streams -----------------------------------------------------------------------------------------------------------
def stream_probe(spark, d):
    s = _stream(spark, d, "documents").select("doc_id", "text")
    return _drained(spark, probe.sem_probe(s, _judge(), parse_specs(["problem: reports a problem"])).select("doc_id", "problem"))


def _line_stream(spark, d):
    x = _stream(spark, d, "doc_inputs").where("lines is not null").select(F.col("input_id").cast("string").alias("file"), F.posexplode(F.concat("lines", F.array(F.lit(None).cast("string")))).alias("pos", "text"), F.size("lines").alias("size"))
    return x.select("file", (F.col("pos") + 1).cast("bigint").alias("num"), F.regexp_replace(F.coalesce("text", F.lit("")), "\\r\\z", "").alias("text"), (F.col("pos") == F.col("size")).alias("eof"))


def stream_filter_near(spark, d):
    """A streaming filter that shows the judge a record on either side of each."""
    near = streams.stream_neighbours(_line_stream(spark, d), 1)
    return _drained(spark, filt.sem_filter(near.withColumnRenamed("before", "earlier").withColumnRenamed("after", "later"), _judge(), QUESTION).select(
        "file", "num", "p", F.length(F.get("earlier", 0)).alias("earlier"), F.length(F.get("later", 0)).alias("later")))


def stream_collapse(spark, d):
    return _drained(spark, streams.stream_collapse(_line_stream(spark, d), streams.equal_texts)).select("file", "num", "n", "text")


def stream_segment(spark, d):
    return _drained(spark, streams.stream_segment(_line_stream(spark, d), streams.new_marker)).select("file", "num", "cut", "segment")


def stream_unwrap(spark, d):
    return _drained(spark, streams.stream_unwrap(_line_stream(spark, d), streams.lowercase_start, dehyphen=True))


QUERIES = {f.__name__: f for f in (
    batch_filter, batch_halves, batch_label, batch_rank, batch_pick, batch_segment, batch_unwrap, wave_budget, wave_stop, questions_encoded, questions_of_specs, tags, windows_of_sources,
    lines_written, texts_written, whole_files, chunks_of_texts, files_by_chunks, csv_written, tsv_written, csv_line_ends, routed_labels, segments_written, ledger_file,
    match_candidates, batch_pick_match, edit_trace, edit_union, edit_choose, context_first, output_lines, sort_reversed, pick_uncertain, columns_gate, columns_padded, walk_gates, quote_exact, sort_suppliers, stream_probe, stream_filter_near, stream_collapse, stream_segment, stream_unwrap,
)}


# --- SQL ---------------------------------------------------------------------------------------------------------------
_STATE = T.estimate_py('"Answer each question about the record it contains."')
_LIMITS = Limits()


def _json_est(json: str) -> str:
    """Estimated tokens of a JSON text whose HTML characters are escaped."""
    return f"(SELECT {_est_sql('x')} FROM (SELECT replace(replace(replace({json}, '<', '\\u003c'), '>', '\\u003e'), '&', '\\u0026') AS x))"


def _asked(question: str, criteria: str = "") -> str:
    """Documents with what they are asked, its size, and their answer by the rules."""
    json = f"""'{{"text":' || CAST(to_json(t) AS VARCHAR) || ',"question":"{question}"}}{criteria}'"""
    return f"""t AS (SELECT doc_id, coalesce({_clean_sql('text')}, '') AS t FROM documents),
      j AS (SELECT doc_id, t, {json} AS json FROM t),
      e AS (SELECT doc_id, t, {_json_est('json')} AS est FROM j),
      a AS (SELECT doc_id, t, est, {_LIMITS.frame + _STATE + _LIMITS.per_question} + est AS need, contains(lower(t), 'review') AS fails, {_p_sql('t')} AS said FROM e)"""


_NOUL = _asked(f"Is it true that `text` {QUESTION}?")
_RAW_NOUL = _asked(QUESTION)


def _errors(room: int) -> str:
    return f"CASE WHEN need > {room} THEN 'too large for a request' WHEN fails THEN 'no review' END"


_LABEL_CRITERIA = Ask("choice", "", {}, options=tuple(LABELS)).criteria()
_WON = "CASE " + " ".join(f"WHEN contains(lower(t), '{x.name}') THEN '{x.name}'" for x in LABELS) + " END"
_WAVES = f"{_NOUL}, w AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // {WAVE} AS wave FROM a), s AS (SELECT wave, sum(est + {_LIMITS.per_question}) AS t FROM w GROUP BY wave), c AS (SELECT wave, sum(t) OVER (ORDER BY wave) AS upto FROM s)"
_ANSWERED = f"CASE WHEN asked AND {_errors(_LIMITS.lone_room)} IS NULL THEN said END AS p, CASE WHEN asked THEN {_errors(_LIMITS.lone_room)} ELSE 'budget' END AS error"


def _greedy(most: int) -> str:
    """From ``base(g, k, cost, own, room)``, ``k`` from 1: ``starts(g, k, w, nxt)``, the first of each request, its number from 0, the first of the next."""
    return f"""r AS (SELECT *, sum(cost) OVER (PARTITION BY g ORDER BY k) AS cum FROM base),
      x AS (SELECT a.g, a.k, CASE WHEN a.own THEN a.k + 1 ELSE least(a.k + {most}, coalesce(min(b.k), a.k + {most})) END AS nxt
        FROM r a LEFT JOIN r b ON b.g IS NOT DISTINCT FROM a.g AND b.k > a.k AND b.k < a.k + {most} AND (b.own OR b.cum - a.cum + a.cost > a.room) GROUP BY a.g, a.k, a.own),
      starts AS (SELECT g, k, CAST(0 AS BIGINT) AS w, nxt FROM x WHERE k = 1 UNION ALL SELECT x.g, x.k, w + 1, x.nxt FROM starts s JOIN x ON x.g IS NOT DISTINCT FROM s.g AND x.k = s.nxt)"""


_LINES = r"""l AS (SELECT doc_id, i, l, sum(length(l) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL))"""


def _matches(pattern: str) -> str:
    """``m(doc_id, i, before, occ, col)``: the matches of each line with their 0-based column."""
    return f"""{_LINES}, y AS (SELECT *, regexp_extract_all(l, '{pattern}') AS ms, regexp_split_to_array(l, '{pattern}') AS ps FROM l),
      z AS (SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM y WHERE len(ms) > 0),
      m AS (SELECT doc_id, i, coalesce(before, 0) AS before, ms[k] AS occ, coalesce(list_sum([length(q) for q in ps[1:k]]), 0) + coalesce(list_sum([length(q) for q in ms[1:k - 1]]), 0) AS col FROM z)"""


_STREAM_LINES = r"""l AS (SELECT CAST(input_id AS VARCHAR) AS file, num, regexp_replace(coalesce(line, ''), '\r$', '') AS text FROM (SELECT input_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS num FROM doc_inputs))"""
SQL = {
    "batch_filter": f"""WITH {_NOUL}, v AS (SELECT doc_id, {_errors(_LIMITS.lone_room)} AS error, said FROM a)
      SELECT doc_id, CASE WHEN error IS NULL THEN said END AS p, CASE WHEN error IS NOT NULL THEN 'failed' WHEN said >= 0.5 THEN 'selected' ELSE 'rejected' END AS verdict, error FROM v""",
    "batch_halves": f"WITH {_NOUL}, v AS (SELECT doc_id, {_errors(SMALL.lone_room)} AS error, said FROM a) SELECT doc_id, CASE WHEN error IS NULL THEN said END AS p, error FROM v",
    "batch_label": f"""WITH {_asked("Which option best fits `text`?", _LABEL_CRITERIA)}, v AS (SELECT doc_id, {_errors(_LIMITS.lone_room)} AS error, {_WON} AS won FROM a)
      SELECT doc_id, CASE WHEN error IS NOT NULL THEN '!' ELSE coalesce(won, '?') END AS label, CASE WHEN error IS NULL THEN CASE WHEN won IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END END AS confidence FROM v""",
    "batch_rank": f"WITH {_NOUL}, v AS (SELECT doc_id, {_errors(_LIMITS.lone_room)} AS error, said FROM a) SELECT doc_id, CASE WHEN error IS NULL THEN said END AS score, error IS NOT NULL AS failed FROM v",
    "wave_budget": f"""WITH {_WAVES}, b AS (SELECT coalesce(max(upto) FILTER (upto <= {BUDGET}), 0) AS spent FROM c),
      u AS (SELECT 1 AS use, w.*, c.upto <= {BUDGET} AS asked FROM w JOIN c USING (wave) UNION ALL SELECT 2, w.*, b.spent + c.upto <= {BUDGET} FROM w JOIN c USING (wave), b)
      SELECT use, doc_id, {_ANSWERED} FROM u""",
    "wave_stop": f"""WITH {_RAW_NOUL}, w AS (SELECT *, (row_number() OVER (ORDER BY doc_id) - 1) // {WAVE} AS wave, {_errors(_LIMITS.lone_room)} AS error FROM a),
      h AS (SELECT wave, count(*) FILTER (error IS NULL AND said >= 0.5) AS n FROM w GROUP BY wave), k AS (SELECT wave, coalesce(sum(n) OVER (ORDER BY wave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h)
      SELECT doc_id, CASE WHEN before >= 60 THEN 'stopped' ELSE coalesce(error, '') END AS error FROM w JOIN k USING (wave)""",
    "questions_encoded": f"""WITH r AS (SELECT doc_id, text, row_number() OVER (PARTITION BY coalesce(source, '-') ORDER BY doc_id) AS place, lag(text) OVER (PARTITION BY coalesce(source, '-') ORDER BY doc_id) AS prev FROM documents)
      SELECT doc_id, place, '{{' || CASE WHEN prev IS NOT NULL THEN '"before":[' || CAST(to_json({_clean_sql('prev')}) AS VARCHAR) || '],' ELSE '' END
        || '"text":' || CAST(to_json(coalesce({_clean_sql('text')}, '')) AS VARCHAR) || ',"f2":"x","question":"Is it true that `text` reports a problem?"}}' AS instructions, '{{"true": "It does"}}' AS criteria, '{{"about": "logs"}}' AS state FROM r""",
    "questions_of_specs": f"""SELECT doc_id, CASE WHEN contains(t, 'invoice') THEN 'invoice' WHEN contains(t, 'error') THEN 'error' WHEN contains(t, 'review') THEN 'review' ELSE 'invoice' END AS topic,
        CASE WHEN m <> '' THEN round(CAST(m AS DOUBLE), 6) WHEN contains(t, 'yes') THEN CAST(0.95 AS DOUBLE) WHEN contains(t, 'maybe') THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.05 AS DOUBLE) END AS bad,
        CASE WHEN lv BETWEEN 0 AND 1 THEN CAST(lv AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS how
      FROM (SELECT doc_id, t, regexp_extract(t, 'p=([0-9]*\\.?[0-9]+)', 1) AS m, TRY_CAST(regexp_extract(t, 'level=([0-9]{{1,3}})', 1) AS INT) AS lv FROM (SELECT doc_id, lower({_clean_sql('text')}) AS t FROM documents WHERE text IS NOT NULL))""",
    "tags": "SELECT o_orderkey, 'L' || CASE WHEN length(CAST(o_orderkey AS VARCHAR)) < 4 THEN lpad(CAST(o_orderkey AS VARCHAR), 4, '0') ELSE CAST(o_orderkey AS VARCHAR) END AS tag FROM orders",
    "windows_of_sources": rf"""WITH RECURSIVE d AS (SELECT coalesce(source, '-') AS g, doc_id, {_clean_sql('text')} AS t FROM documents WHERE regexp_matches(text, '[^\s\x0b\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]')),
      s0 AS (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id) AS k, (SELECT {_est_sql('x')} FROM (SELECT t AS x)) AS cost FROM d),
      base AS (SELECT g, k, cost, cost > 2000 AS own, 2000 AS room FROM s0), {_greedy(40)}
      SELECT s.g AS file, s.w AS "window", (SELECT count(*) FROM base b WHERE b.g = s.g AND b.k >= s.k AND b.k < s.nxt) AS n FROM starts s""",
    "lines_written": "SELECT row_number() OVER (ORDER BY o_orderkey) AS num, o_orderpriority || ' ' || o_orderkey AS text, 1 AS missing FROM orders",
    "texts_written": "SELECT row_number() OVER (ORDER BY doc_id) AS num, length(text) AS n, md5(text) AS md5 FROM documents WHERE text <> '' AND NOT contains(text, chr(0))",
    "whole_files": "SELECT file_idx, row_number() OVER (PARTITION BY file_idx ORDER BY n_nationkey) AS num, n_name AS text FROM nation JOIN (VALUES (0, 1), (1, 0), (2, 1)) AS f(file_idx, k) ON n_regionkey = k",
    "chunks_of_texts": "SELECT CAST(doc_id AS INT) AS file_idx, length(coalesce(text, '')) AS chars, true AS within FROM documents",
    "files_by_chunks": f"SELECT CAST(doc_id AS INT) AS doc_id, p, CASE WHEN p >= 0.5 THEN 'selected' ELSE 'rejected' END AS verdict FROM (SELECT doc_id, {_p_sql('t')} AS p FROM (SELECT doc_id, coalesce({_clean_sql('text')}, '') AS t FROM documents))",
    "csv_written": f"SELECT 'key,name,segment' AS header, row_number() OVER (ORDER BY c_custkey) AS num, CAST(c_custkey AS VARCHAR) AS key, c_name || ', \"q\"; x' AS name, c_mktsegment AS segment FROM customer",
    "tsv_written": "SELECT 'key,name,segment' AS header, row_number() OVER (ORDER BY c_custkey) AS num, CAST(c_custkey AS VARCHAR) AS key, c_name AS name, c_mktsegment AS segment FROM customer",
    "csv_line_ends": "SELECT 'key,name' AS header, CAST(s_suppkey AS VARCHAR) AS key, s_name || chr(10) || '\"second\", line' AS name FROM supplier",
    "routed_labels": "SELECT coalesce(source, '-') AS one, CAST(doc_id % 3 AS VARCHAR) AS two, count(*) AS n FROM documents GROUP BY ALL",
    "segments_written": "SELECT CAST(segment AS INT) AS segment, count(*) AS n FROM (SELECT 1 + sum(CASE WHEN n_nationkey > 0 AND contains(n_name, 'I') THEN 1 ELSE 0 END) OVER (ORDER BY n_nationkey) AS segment FROM nation) GROUP BY 1",
    "ledger_file": "SELECT day, coalesce(tool, '') AS tool, CAST(sum(CAST(coalesce(usd, 0) AS DECIMAL(24, 6))) AS DOUBLE) AS usd, CAST(sum(coalesce(tokens, 0)) AS BIGINT) AS tokens FROM ledger GROUP BY day, tool",
    "match_candidates": rf"""WITH {_matches(r'[a-z]+@[a-z]+\.example')} SELECT doc_id, occ AS span, CAST(arg_min(i, before + col) AS INT) AS line, CAST(min(before + col) AS INT) AS start FROM m GROUP BY doc_id, occ""",
    "edit_trace": f"""WITH {_matches('[0-9]{2,}')} SELECT doc_id, CAST(i AS INT) AS line, CAST(col + 1 AS INT) AS col, occ, CASE WHEN i % 2 = 1 THEN CAST(0.95 AS DOUBLE) ELSE CAST(0.05 AS DOUBLE) END AS p, i % 2 = 1 AS acted,
      CASE WHEN i % 2 = 1 THEN '<' || occ || '>' END AS replacement FROM m""",
    "edit_union": "SELECT doc_id, regexp_replace(text, '[A-Z]+-[0-9]+|[0-9]+', '', 'g') AS text, CAST(len(regexp_extract_all(text, '[A-Z]+-[0-9]+|[0-9]+')) AS INT) AS changed FROM documents WHERE text IS NOT NULL",
    "edit_choose": """SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: CASE i % 3 WHEN 0 THEN regexp_replace(l, '[0-9]+', 'yes', 'g') WHEN 1 THEN regexp_replace(l, '[0-9]+', 'no', 'g') ELSE l END), chr(10)) AS text
      FROM documents WHERE text IS NOT NULL""",
    "sort_suppliers": "SELECT CAST(s_suppkey AS BIGINT) AS num, row_number() OVER (ORDER BY seed, s_suppkey) - 1 AS pos, seed FROM (SELECT s_suppkey, CAST(least(4, (s_suppkey * 7 + 3) % 25 // 5) AS DOUBLE) AS seed FROM supplier)",
    "stream_probe": f"SELECT doc_id, {_p_sql('t')} AS problem FROM (SELECT doc_id, coalesce({_clean_sql('text')}, '') AS t FROM documents)",
    "stream_filter_near": f"WITH {_STREAM_LINES} SELECT file, num, {_p_sql(_clean_sql('text'))} AS p, length(lag(text) OVER w) AS earlier, length(lead(text) OVER w) AS later FROM l WINDOW w AS (PARTITION BY file ORDER BY num)",
    "stream_collapse": f"""WITH {_STREAM_LINES}, b AS (SELECT *, CASE WHEN lag(text) OVER w IS NOT DISTINCT FROM text AND num > 1 THEN 0 ELSE 1 END AS brk FROM l WINDOW w AS (PARTITION BY file ORDER BY num)),
      g AS (SELECT *, sum(brk) OVER (PARTITION BY file ORDER BY num) AS run FROM b) SELECT file, min(num) AS num, count(*) AS n, arg_min(text, num) AS text FROM g GROUP BY file, run""",
    "stream_segment": f"WITH {_STREAM_LINES} SELECT file, num, num > 1 AND contains(text, 'NEW') AS cut, 1 + CAST(sum(CASE WHEN num > 1 AND contains(text, 'NEW') THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY num) AS BIGINT) AS segment FROM l",
    # rules as the function judge has them: no marker in the text decides
    "stream_unwrap": "WITH " + _UNWRAP.replace(f"regexp_replace({_clean_sql('line')}, '^[ \\t>]+', '') AS seen", "regexp_replace(line, '^[ \\t>]+', '') AS seen").replace("p=([0-9]*", "\\x{0}p=([0-9]*") + f", {_WRAPPED} SELECT CAST(file AS VARCHAR) AS file, min(num) AS num, count(*) AS n, string_agg(piece, '' ORDER BY num) AS text FROM q GROUP BY file, para",
}
SQL["batch_segment"], SQL["batch_unwrap"] = OPS["segment_events"], OPS["unwrap_docs"]
SQL["batch_pick"] = rf"""WITH l AS (SELECT input_id AS file, num, {_clean_sql("regexp_replace(coalesce(line, ''), '" + chr(92) + "r$', '')")} AS t FROM (SELECT input_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS num FROM doc_inputs)),
      r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY p DESC, num) AS place, max(p) OVER (PARTITION BY file) AS top FROM (SELECT file, num, {_p_sql('t')} AS p FROM l WHERE regexp_matches(t, '[^{_SPACE}]')))
      SELECT file, place, num, p, 'yes' AS verdict FROM r WHERE place <= 2 AND top >= 0.5"""
SQL["walk_paths"] = """WITH f AS (SELECT DISTINCT file FROM documents WHERE starts_with(file, 'app-log/p00/')), n AS (SELECT count(*) AS n FROM f),
      e AS (SELECT file, row_number() OVER (ORDER BY file) AS k FROM f)
      SELECT 'app-log/p00' AS path, true AS is_dir, CASE WHEN n <= 253 THEN CAST(0.9 AS DOUBLE) ELSE round(sqrt(CAST(0.9 AS DOUBLE) * 0.95), 9) END AS score, 1 AS place FROM n WHERE n > 0
      UNION ALL SELECT file, false, round(sqrt(CAST(0.9 AS DOUBLE) * 0.05), 9), CAST(k + 1 AS INT) FROM e, n WHERE n > 253 AND k <= 2"""
SQL["quote_requests"] = f"""WITH RECURSIVE q AS (SELECT DISTINCT item_id, state_id, state_est, est FROM items),
      base AS (SELECT state_id AS g, row_number() OVER (PARTITION BY state_id ORDER BY item_id) AS k, coalesce(est + {_LIMITS.per_question}, 0) AS cost, est,
        coalesce({_LIMITS.frame + _LIMITS.per_question} + state_est + est > {_LIMITS.lone_room}, true) AS own, {_LIMITS.room - _LIMITS.frame} - state_est AS room FROM q), {_greedy(_LIMITS.questions)}
      SELECT s.g AS state_id, s.w AS request, count(*) AS questions, CAST(sum(b.est) AS BIGINT) AS est FROM starts s JOIN base b ON b.g IS NOT DISTINCT FROM s.g AND b.k >= s.k AND b.k < s.nxt GROUP BY s.g, s.w"""
SQL["quote_plan"] = f"""WITH t AS (SELECT coalesce(text, '') AS t FROM documents), j AS (SELECT '{{"text":' || CAST(to_json(t) AS VARCHAR) || ',"question":"Is it a problem?"}}' AS json FROM t),
      e AS (SELECT count(*) AS n, CAST(sum({_json_est('json')}) AS BIGINT) AS est FROM j),
      r AS (SELECT n, est, greatest((n + {_LIMITS.questions - 1}) // {_LIMITS.questions}, (est + n * {_LIMITS.per_question} + {_LIMITS.room - _LIMITS.frame - _STATE - 1}) // {_LIMITS.room - _LIMITS.frame - _STATE}) AS requests FROM e),
      k AS (SELECT n, requests, requests * {_LIMITS.frame + _STATE} + CAST(floor(n * (CAST(est AS DOUBLE) / n + {_LIMITS.per_question})) AS BIGINT) AS tokens FROM r)
      SELECT n AS questions, requests, tokens, tokens * CAST(0.05 AS DOUBLE) / 1e6 AS usd FROM k"""
SQL["segment_min"] = """WITH RECURSIVE r AS (SELECT user_id, event_type AS text, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS num FROM events),
      f AS (SELECT user_id, num FROM r WHERE num > 1 AND contains(text, 'signup')),
      c AS (SELECT DISTINCT user_id, CAST(1 AS BIGINT) AS num, CAST(1 AS BIGINT) AS segment FROM r
        UNION ALL SELECT c.user_id, (SELECT min(f.num) FROM f WHERE f.user_id = c.user_id AND f.num >= c.num + 4) AS num, c.segment + 1 FROM c WHERE c.num IS NOT NULL),
      s AS (SELECT user_id, segment, num AS "first", coalesce(lead(num) OVER (PARTITION BY user_id ORDER BY segment) - 1, (SELECT max(r.num) FROM r WHERE r.user_id = c.user_id)) AS "last" FROM c WHERE num IS NOT NULL)
      SELECT user_id, segment, "last" - "first" + 1 AS n, "first", "last", CASE WHEN segment > 1 THEN CAST(0.95 AS DOUBLE) END AS p FROM s"""
SQL["pick_match"] = rf"""WITH {_matches(r'[a-z]+@[a-z]+\.example')}, o AS (SELECT doc_id, occ AS span, CAST(arg_min(i, before + col) AS INT) AS line, min(before + col) AS start, starts_with(occ, 'billing') AS b FROM m GROUP BY doc_id, occ),
      k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY b DESC, start) AS n FROM o)
      SELECT doc_id, span, line, CASE WHEN b THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.6 AS DOUBLE) END AS p, CASE WHEN b THEN 'yes' ELSE 'uncertain' END AS verdict FROM k WHERE n = 1"""
SQL["output_lines"] = f"""WITH {_DOCS} SELECT doc_id, md5(printf('%.2f', p) || chr(9) || file || CASE WHEN p >= 0.5 THEN ':' ELSE '-' END || num || CASE WHEN p >= 0.5 THEN ':' ELSE '-' END || coalesce(text, '')) AS md5 FROM docs"""
SQL["sort_reversed"] = "SELECT CAST(n_nationkey AS BIGINT) AS num, row_number() OVER (ORDER BY (n_nationkey * 7 + 3) % 25) - 1 AS pos FROM nation ORDER BY pos DESC LIMIT 5"
SQL["pick_uncertain"] = f"""WITH {_DOCS}, r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY p DESC, num) AS place, max(p) OVER (PARTITION BY file) AS top FROM docs WHERE regexp_matches(text, '[^{_SPACE}]'))
      SELECT file, place, num, CASE WHEN p < 0.85 THEN 'uncertain' ELSE 'yes' END AS verdict FROM r WHERE place <= 3 AND top >= 0.5"""
SQL["columns_gate"] = "SELECT * FROM (VALUES ('sure', 'yes', 1), ('unsure', 'uncertain', 0), ('none', 'no', 0)) AS v(asked, verdict, n)"
SQL["columns_padded"] = "SELECT file, num, coalesce(string_split(text, ',')[8], '') AS eighth, string_split(text, ',')[1] AS first FROM csv_rows WHERE text IS NOT NULL"
SQL["walk_gates"] = """SELECT gate, 'memo/p00' AS path, CAST(s AS DOUBLE) AS score FROM (VALUES ('kept', 0.9), ('verified', 0.95)) AS v(gate, s) WHERE EXISTS (FROM documents WHERE starts_with(file, 'memo/p00/'))"""
SQL["quote_exact"] = f"""WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), j AS (SELECT doc_id, '{{"text":' || CAST(to_json(t) AS VARCHAR) || ',"question":"Is it a problem?"}}' AS json FROM t),
      q AS (SELECT doc_id, {_json_est('json')} AS est FROM j),
      base AS (SELECT 0 AS g, row_number() OVER (ORDER BY doc_id) AS k, est + {_LIMITS.per_question} AS cost, est, {_LIMITS.frame + _LIMITS.per_question + _STATE} + est > {_LIMITS.lone_room} AS own, {_LIMITS.room - _LIMITS.frame - _STATE} AS room FROM q), {_greedy(_LIMITS.questions)},
      n AS (SELECT count(*) AS requests FROM starts), b AS (SELECT count(*) AS questions, CAST(sum(cost) AS BIGINT) AS once, CAST(sum(floor(0.8 * ({_STATE} + est) + 0.5) + 47) AS BIGINT) AS each FROM base)
      SELECT 'state once' AS billing, questions, requests, requests * {_LIMITS.frame + _STATE} + once AS tokens FROM n, b UNION ALL SELECT 'per question', questions, requests, each FROM n, b"""
SQL["batch_pick_match"] = SQL["pick_match"]
SQL["context_first"] = f"""WITH {_DOCS}, h AS (SELECT file, num FROM docs WHERE p >= 0.9 ORDER BY file, num LIMIT 20), z AS (SELECT file AS lf, num AS ln FROM h ORDER BY file DESC, num DESC LIMIT 1),
      n AS (SELECT d.file, d.num, d.p, max(CAST(h.num = d.num AS INT)) = 1 AS match FROM docs d JOIN h ON d.file = h.file AND d.num BETWEEN h.num - 1 AND h.num + 2 GROUP BY ALL)
      SELECT file, num, CASE WHEN file < lf OR (file = lf AND num <= ln) THEN p END AS p, match FROM n, z"""
