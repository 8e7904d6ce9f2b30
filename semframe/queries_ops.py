"""Registered queries of the record operators, each with the SQL that DuckDB answers alike.

Judges are expressions here, so that SQL can say the same: ``RULES`` gives a probability to the first word that a text holds.
"""

from __future__ import annotations

import datetime as dt
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semframe.functions import text as T
from semframe.functions.templates import Label, parse_specs, parse_taxonomy
from semframe.operators import bisect, collapse, columns, edit, evaluate, filter as filt, label, pick, probe, rank, segment, sort, test as whole, unwrap, walk
from semframe.operators.options import keyword_options
from semframe.operators.sequence import numbered
from semframe.plans import ledger, oracles as O, planner
from semframe.plans.judge import Ask
from semframe.session import ensure_checkpoint_dir, table
from semframe.sources import records as R
from semframe.sources import tree
from semframe.streaming import streams

RULES = [("error", 0.95), ("invoice", 0.8), ("warn", 0.5), ("the ", 0.3)]
LABELS = [Label("invoice", "about money"), Label("error"), Label("review"), Label("build")]
TAXONOMY = "log\n  error\n  warn\nmail\n  invoice\n  order\nother\n"
P = "p"


def _judge() -> O.ExprJudge:
    return O.rule_oracle(RULES)


def _p_sql(t: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({t}), '{w}') THEN CAST({p} AS DOUBLE)" for w, p in RULES) + " ELSE CAST(0.05 AS DOUBLE) END"


_ESC = r"\x1B(?:\[[0-?]*[ -/]*[@-~]|[\]PX^_][^\x07\x1B\n]*(?:\x07|\x1B\\)?|[ -/]*[0-Z\\^-~])"


def _plain_sql(t: str) -> str:
    return f"regexp_replace({t}, '{_ESC}', '', 'g')"


def _clean_sql(t: str) -> str:
    return rf"regexp_replace({_plain_sql(t)}, '[\x00-\x08\x0B-\x1F\x7F-\x{{9F}}]', '', 'g')"


def docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents as records: the file is the source, the order the id."""
    x = table(spark, d, "documents").select("doc_id", "text", F.coalesce("source", F.lit("-")).alias("file"))
    return numbered(x, ["file"], ["doc_id"])


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", F.coalesce("source", F.lit("-")).alias("file"), F.lit(0).alias("file_idx"), F.col("doc_id").alias("num"))


_DOCS = f"""docs AS (SELECT doc_id, text, coalesce(source, '-') AS file, row_number() OVER (PARTITION BY coalesce(source, '-') ORDER BY doc_id) AS num,
  {_p_sql("coalesce(" + _clean_sql('text') + ", '')")} AS p FROM documents)"""


# --- filter ------------------------------------------------------------------------------------------------------------
def filter_basic(spark, d):
    return filt.selected(filt.sem_filter(_docs(spark, d), _judge(), "reports a problem")).select("doc_id", "p")


def filter_invert(spark, d):
    return filt.selected(filt.sem_filter(_docs(spark, d), _judge(), "reports a problem", invert=True)).select("doc_id", "p")


def filter_threshold(spark, d):
    return filt.selected(filt.sem_filter(_docs(spark, d), _judge(), "reports a problem", threshold=0.9)).select("doc_id", "p")


def filter_band_verdicts(spark, d):
    judged = filt.sem_filter(_docs(spark, d), _judge(), "reports a problem", band=(0.3, 0.7))
    return judged.groupBy("file", "verdict").agg(F.count(F.lit(1)).alias("n"))


def filter_uncertain(spark, d):
    return filt.uncertain(filt.sem_filter(_docs(spark, d), _judge(), "reports a problem", band=(0.3, 0.7), invert=True)).select("doc_id", "p")


def filter_count_per_source(spark, d):
    judged = filt.sem_filter(_docs(spark, d), _judge(), "reports a problem", threshold=0.9)
    return filt.count_per_file(judged, judged, ["file"])


def filter_totals(spark, d):
    return filt.totals(filt.sem_filter(_docs(spark, d), _judge(), "reports a problem"))


def filter_first(spark, d):
    return filt.selected(filt.sem_filter(_docs(spark, d), _judge(), "reports a problem"), limit=25).select("doc_id", "p")


def filter_context(spark, d):
    judged = filt.sem_filter(docs(spark, d), _judge(), "reports a problem", threshold=0.9)
    return filt.with_context(judged, before=2, after=1, group=["file"]).select("file", "num", "doc_id", "p", "match", "gap")


def filter_neighbours(spark, d):
    near = R.with_neighbours(docs(spark, d), 1, ["file"])
    return near.select("doc_id", F.length(F.get("before", 0)).alias("before"), F.length(F.get("after", 0)).alias("after"))


def filter_fields(spark, d):
    x = R.with_fields(table(spark, d, "csv_rows").select("file", "num", "text"), ",")
    judged = filt.sem_filter(x, O.rule_oracle([(".example", 0.9)]), "Is {3} a mail address?", delimiter=",")
    return filt.selected(judged).select("file", "num", F.size("fields").alias("n"))


def files_any_chunk(spark, d):
    x = _inputs(spark, d).withColumnRenamed("num", "chunk")
    return filt.sem_filter_files(x, _judge(), "mentions an error", group=["file"]).select("file", "p", "failed", "verdict")


# --- tests and choices -------------------------------------------------------------------------------------------------
def _tested(combine: str, **kw):
    def run(spark, d):
        return whole.sem_test(_docs(spark, d), _judge(), "Does it report a problem?", combine=combine, group=["file"], **kw).select("file", F.round("p", 9).alias("p"), "verdict")

    return run


def choose_labels(spark, d):
    return whole.sem_choose(_docs(spark, d), O.default_oracle(), LABELS, other="other", threshold=0.5).select("doc_id", "label", "confidence", "verdict")


def choose_probs(spark, d):
    got = whole.sem_choose(_docs(spark, d), O.default_oracle(), LABELS)
    return whole.distribution(got, [x.name for x in LABELS], keep=["doc_id"]).withColumn("p", F.round("p", 9))


# --- labels ------------------------------------------------------------------------------------------------------------
def _labelled(spark, d, **kw):
    return label.sem_label(_docs(spark, d), O.default_oracle(), LABELS, **kw)


def label_basic(spark, d):
    return _labelled(spark, d).select("doc_id", "label", "confidence")


def label_unsure(spark, d):
    return _labelled(spark, d, threshold=0.5).select("doc_id", "label")


def label_only(spark, d):
    return _labelled(spark, d, threshold=0.5, only=["error", "?"]).select("doc_id", "label")


def label_counts(spark, d):
    return label.label_counts(_labelled(spark, d, threshold=0.5), ["doc_id"])


def label_priorities(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.lower("o_orderpriority").alias("text"))
    labels = [Label("urgent"), Label("high"), Label("medium"), Label("low"), Label("not")]
    out = label.sem_label(o, O.keyword_oracle(), labels, other="other")
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def label_tree(spark, d):
    x = _docs(spark, d)
    out = label.sem_label_tree(x, keyword_options("last"), parse_taxonomy(TAXONOMY), key=["doc_id"], beam=1)
    return out.select("doc_id", "label", F.round("confidence", 9).alias("confidence"))


# --- order -------------------------------------------------------------------------------------------------------------
def rank_score(spark, d):
    x = rank.sem_rank(_docs(spark, d), _judge(), "reports a problem", top=200, ties=["doc_id"])
    return x.select("doc_id", "score")


def rank_worst(spark, d):
    return rank.sem_rank(_docs(spark, d), _judge(), "reports a problem", top=50, reverse=True, ties=["doc_id"]).select("doc_id", "score")


def rank_levels(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.concat(F.lit("level="), F.pmod("p_size", F.lit(6))).alias("text"))
    out = rank.sem_rank(x, O.default_oracle(), "how large", levels=["s", "m", "l", "xl"], top=300, ties=["p_partkey"])
    return out.select("p_partkey", "score")


def _sort_input(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("num"), F.concat(F.lit("item "), F.pmod(F.col("n_nationkey") * 7 + 3, F.lit(25))).alias("text"))


def sort_seed(spark, d):
    return sort.sem_sort(_sort_input(spark, d), O.number_order(), "by number", passes=0, ties=["num"]).select("num", "pos", "seed")


def sort_full(spark, d):
    return sort.sem_sort(_sort_input(spark, d), O.number_order(), "by number", passes=30, ties=["num"]).select("num", "pos")


def pick_best(spark, d):
    x = docs(spark, d)
    return pick.sem_pick(x, _judge(), "Which reports a problem?", best=2, group=["file"]).select("file", "place", "num", "p", "verdict")


def pick_windows(spark, d):
    x = docs(spark, d)
    got = pick.sem_pick(x, _judge(), "Which reports a problem?", best=3, group=["file"], window=16, tokens=10**9, force=True)
    return got.select("file", "place", "num", "p")


def pick_match(spark, d):
    x = table(spark, d, "documents").select("doc_id", "text").where(F.col("text").isNotNull())
    j = O.ExprJudge(lambda ask: O.answer(noul=F.when(ask.about["span"].startswith("billing"), 0.9).otherwise(0.6)))
    return pick.sem_pick_match(x, j, [r"[a-z]+@[a-z]+\.example"], "Where do bills go?", key=["doc_id"], threshold=0.8).select("doc_id", "span", "line", "p", "verdict")


# --- runs, segments, lines ---------------------------------------------------------------------------------------------
def _events(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("text"))
    return numbered(e, ["user_id"], ["ts", "event_id"])


def _collapsed(keep: str):
    def run(spark, d):
        out = collapse.sem_collapse(_events(spark, d), O.equal_texts(), keep=keep, group=["user_id"])
        return out.select("user_id", "run", "n", "num", "text")

    return run


def segment_events(spark, d):
    return segment.segments(segment.sem_segment(_events(spark, d), O.new_marker("signup"), group=["user_id"]), ["user_id"])


def segment_min(spark, d):
    return segment.segments(segment.sem_segment(_events(spark, d), O.new_marker("signup"), min_len=4, group=["user_id"]), ["user_id"])


def _inputs(spark, d):
    """The lines of doc_inputs as records, one CR before their end taken off."""
    x = table(spark, d, "doc_inputs").select(F.col("input_id").alias("file"), F.posexplode("lines").alias("num", "text"))
    return x.select("file", (F.col("num") + 1).cast("bigint").alias("num"), F.regexp_replace(F.coalesce("text", F.lit("")), "\\r\\z", "").alias("text"))


def unwrap_lines(spark, d):
    out = unwrap.sem_unwrap_lines(_inputs(spark, d), O.lowercase_start(), group=["file"])
    return out.select("file", "num", "kind", "p", "join", "para")


def unwrap_docs(spark, d):
    return unwrap.sem_unwrap(_inputs(spark, d), O.lowercase_start(), dehyphen=True, group=["file"])


# --- edits -------------------------------------------------------------------------------------------------------------
def _texts(spark, d):
    return table(spark, d, "documents").select("doc_id", "text").where(F.col("text").isNotNull())


def _edited(**kw):
    """Edits on odd lines only."""
    j = O.ExprJudge(lambda ask: O.answer(noul=F.when(F.col("line") % 2 == 1, 0.95).otherwise(0.05)))

    def run(spark, d):
        return edit.sem_edit(_texts(spark, d), j, "stands on an odd line", key=["doc_id"], **kw)[0].select("doc_id", "text")

    return run


def _edit_sql(what: str) -> str:
    return f"""SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda l, i: CASE WHEN i % 2 = 1 THEN {what} ELSE l END), chr(10)) AS text
      FROM documents WHERE text IS NOT NULL"""


# --- search, columns, probes -------------------------------------------------------------------------------------------
def bisect_flip(spark, d):
    o = table(spark, d, "orders").select("o_orderdate", "o_orderkey", F.col("o_orderdate").cast("string").alias("text"))
    j = O.column_oracle(F.when(F.col("o_orderdate") >= F.lit("1995-06-17").cast("timestamp"), 0.95).otherwise(0.05))
    flip, rows = bisect.sem_bisect(o, j, "is after the change", by=["o_orderdate", "o_orderkey"])
    return bisect.around(rows, flip).select("pos", "o_orderkey")


def bisect_invert(spark, d):
    o = table(spark, d, "events").select("ts", "event_id", F.col("event_type").alias("text"))
    j = O.column_oracle(F.when(F.col("event_id") < 333, 0.95).otherwise(0.05))
    flip, rows = bisect.sem_bisect(o, j, "is before the change", by=["event_id"], invert=True)
    return bisect.around(rows, flip).select("pos", "event_id")


def columns_by_description(spark, d):
    verdict, out = columns.sem_columns(table(spark, d, "customer"), columns.header_oracle(), ["the c_custkey", "c_mktsegment of the customer", "what is the c_acctbal"])
    return out


SPECS = ["problem: reports a problem", "topic: what is it about [invoice|error|review]", "heat: how bad <low|mid|high>"]


def probe_columns(spark, d):
    x = _docs(spark, d).withColumn("text", F.concat(F.coalesce("text", F.lit("")), F.lit(" level="), F.pmod("doc_id", F.lit(4)).cast("string")))
    out = probe.sem_probe(x, O.default_oracle(), parse_specs(SPECS), scores=True)
    return out.select("doc_id", "problem", "topic", F.col("`topic.conf`").alias("topic_conf"), "heat")


def probe_json(spark, d):
    e = R.jsonl(table(spark, d, "events").select("event_id", F.col("props").alias("text")))
    specs = parse_specs(["seven: holds a seven", "size: how large <low|mid|high>"])
    out = probe.sem_probe(e.drop("parsed"), O.rule_oracle([("7", 0.9)]), specs)
    return probe.as_json(out, specs, parsed=True).select("event_id", "json")


def walk_paths(spark, d):
    nodes = tree.nodes_of_paths(table(spark, d, "documents").select(F.col("file").alias("path")))
    return walk.sem_walk(nodes, walk.path_words(), "app-log p00 HERE", results=3, least=0.0).select("path", "is_dir", F.round("score", 9).alias("score"), "place")


def tree_nodes(spark, d):
    return tree.nodes_of_paths(table(spark, d, "documents").select(F.col("file").alias("path"))).select("path", "parent", "name", "is_dir", "files")


# --- planning, ledger, evaluation --------------------------------------------------------------------------------------
def quote_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", T.estimate(F.coalesce("text", F.lit(""))).alias("tokens"))


def quote_plan(spark, d):
    q = planner.plan(_docs(spark, d), Ask("noul", "Is it a problem?", {"text": F.coalesce(F.col("text"), F.lit(""))}), price=0.05)
    return spark.createDataFrame([(q.questions, q.requests, q.tokens, q.usd)], "questions bigint, requests bigint, tokens bigint, usd double")


def quote_requests(spark, d):
    x = table(spark, d, "items").select("item_id", "state_id", "state_est", "est").distinct()
    out = planner.packed_requests(x, group=["state_id"], by=["item_id"])
    return out.groupBy("state_id", "request").agg(F.count(F.lit(1)).alias("questions"), F.sum("est").alias("est"))


def text_clean(spark, d):
    x = _inputs(spark, d)
    return x.select("file", "num", T.clean(F.col("text")).alias("text"), T.clip(T.clean(F.col("text")), 40).alias("clipped"))


def _ledger(spark, d):
    return table(spark, d, "ledger").select("day", "tool", F.coalesce("usd", F.lit(0.0)).alias("usd"), F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"))


LAST, MONTH = dt.date(2026, 10, 30), "2026-09"


def ledger_by_day(spark, d):
    return ledger.spend_by_day(_ledger(spark, d), LAST, 90)


def ledger_by_tool(spark, d):
    return ledger.spend_by_tool(_ledger(spark, d), MONTH)


def ledger_spent(spark, d):
    return ledger.spent(_ledger(spark, d), dt.date(2026, 9, 14))


def ledger_merged(spark, d):
    x = _ledger(spark, d)
    out = ledger.merged(x.where(F.col("day") < "2026-10-01"), x.where(F.col("day") >= "2026-09-15"), LAST)
    return out.select("day", "tool", F.round("usd", 6).alias("usd"), "tokens")


def eval_metrics(spark, d):
    x = filt.sem_filter(_docs(spark, d), _judge(), "reports a problem").withColumn("label", F.col("file").isin("app-log", "ci-log", "alerts").cast("int"))
    out = evaluate.evaluate(x)
    return out.select("n", "positives", *[F.round(c, 9).alias(c) for c in ("accuracy", "best_threshold", "best_accuracy", "auc", "mean_pos", "mean_neg")])


# --- records and streams -----------------------------------------------------------------------------------------------
def records_lines(spark, d):
    x = table(spark, d, "documents").select("doc_id", "text")
    return R.records_of(x).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("text")).alias("longest"))


def records_paragraphs(spark, d):
    x = table(spark, d, "documents").select("doc_id", "text")
    return R.records_of(x, R.PARA).select("doc_id", "num", F.length("text").alias("n"))


def _stream(spark, d, name):
    path, schema = os.path.join(d, f"{name}.parquet"), table(spark, d, name).schema
    reader = spark.readStream.schema(schema)
    return reader.parquet(path) if os.path.isdir(path) else reader.option("pathGlobFilter", f"{name}.parquet").parquet(d)


def _drained(spark, stream):
    ensure_checkpoint_dir(spark)
    where = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp()
    name = "s" + uuid.uuid4().hex
    return streams.drain(stream, name, f"{where}/{name}")


def stream_filter(spark, d):
    s = _stream(spark, d, "documents").select("doc_id", "text")
    return _drained(spark, filt.selected(filt.sem_filter(s, _judge(), "reports a problem")).select("doc_id", "p"))


def stream_label(spark, d):
    s = _stream(spark, d, "documents").select("doc_id", "text")
    return _drained(spark, label.sem_label(s, O.default_oracle(), LABELS, threshold=0.5).select("doc_id", "label"))


QUERIES = {f.__name__: f for f in (
    filter_basic, filter_invert, filter_threshold, filter_band_verdicts, filter_uncertain, filter_count_per_source, filter_totals, filter_first, filter_context,
    filter_neighbours, filter_fields, files_any_chunk, choose_labels, choose_probs, label_basic, label_unsure, label_only, label_counts, label_priorities, label_tree,
    rank_score, rank_worst, rank_levels, sort_seed, sort_full, pick_best, pick_windows, pick_match, segment_events, segment_min, unwrap_lines, unwrap_docs,
    bisect_flip, bisect_invert, columns_by_description, probe_columns, probe_json, walk_paths, tree_nodes, quote_tokens, quote_plan, quote_requests, text_clean,
    ledger_by_day, ledger_by_tool, ledger_spent, ledger_merged, eval_metrics, records_lines, records_paragraphs, stream_filter, stream_label,
)}
QUERIES |= {"test_any": _tested("any"), "test_all": _tested("all"), "test_mean": _tested("mean"), "test_band": _tested("any", band=(0.6, 0.9), invert=True)}
QUERIES |= {f"collapse_{k}": _collapsed(k) for k in ("first", "repeated", "unique", "all")}
QUERIES |= {
    "edit_squeeze": _edited(action="squeeze", set1="!=-"), "edit_delete": _edited(action="delete", set1="[:digit:]"), "edit_translate": _edited(action="translate", set1="a-c", set2="A-C"),
    "edit_regex": _edited(patterns=[r"([A-Z]+)-(\d+)"], template="${2}/$1"),
}

# --- SQL ---------------------------------------------------------------------------------------------------------------
_NAMED = "CASE " + " ".join(f"WHEN contains(lower(t), '{x.name}') THEN '{x.name}'" for x in LABELS) + " END"
_NAMED_CTE = f"named AS (SELECT doc_id, {_NAMED} AS won FROM (SELECT doc_id, coalesce({_clean_sql('text')}, '') AS t FROM documents))"
_RUNS = """r AS (SELECT user_id, event_type AS text, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS num FROM events),
b AS (SELECT *, CASE WHEN lag(text) OVER w IS NOT DISTINCT FROM text THEN 0 ELSE 1 END AS brk FROM r WINDOW w AS (PARTITION BY user_id ORDER BY num)),
g AS (SELECT *, CAST(sum(brk) OVER (PARTITION BY user_id ORDER BY num) AS BIGINT) AS run FROM b),
h AS (SELECT user_id, run, count(*) AS n, min(num) AS num, arg_min(text, num) AS text FROM g GROUP BY ALL)"""
_SPACE = r"\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_FENCE_SQL = r"regexp_matches(line, '^ {0,3}(```|~~~)')"
_UNWRAP = rf"""
l AS (SELECT file, num, regexp_replace(coalesce(line, ''), '\r$', '') AS line FROM (SELECT input_id AS file, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS num FROM doc_inputs)),
f AS (SELECT *, coalesce(sum(CAST({_FENCE_SQL} AS INT)) OVER (PARTITION BY file ORDER BY num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM l),
k AS (SELECT *, CASE WHEN NOT regexp_matches(line, '[^{_SPACE}]') THEN 'blank'
   WHEN inside OR {_FENCE_SQL} OR regexp_matches(line, '^ {{0,3}}#{{1,6}}([ \t\f\r\n]|$)') OR regexp_matches(line, '^ {{0,3}}[-=*_]([ \t\f\r]*[-=*_]){{2,}}[ \t\f\r]*$')
     OR regexp_matches(line, '^[ \t\f\r]*\|') OR starts_with(line, chr(9)) OR starts_with(line, '    ') THEN 'fixed'
   WHEN regexp_matches(line, '^[ \t\f\r]*([-*+•‣◦]|[0-9]{{1,3}}[.)]|[a-zA-Z][.)])[ \t\f\r]+') OR regexp_matches(line, '^[ \t\f\r]*>') THEN 'starts' ELSE 'plain' END AS kind FROM f),
a AS (SELECT *, lag(line) OVER w AS prev, lag(kind) OVER w AS pk FROM k WINDOW w AS (PARTITION BY file ORDER BY num)),
c AS (SELECT *, prev IS NOT NULL AND kind NOT IN ('blank', 'fixed') AND pk NOT IN ('blank', 'fixed')
   AND (kind <> 'starts' OR (regexp_matches(line, '^[ \t\f\r]*>') AND regexp_matches(prev, '^[ \t\f\r]*>'))) AS cand, regexp_replace({_clean_sql('line')}, '^[ \t>]+', '') AS seen FROM a),
p AS (SELECT *, CASE WHEN cand THEN CASE WHEN regexp_extract(seen, 'p=([0-9]*\.?[0-9]+)', 1) <> '' THEN CAST(regexp_extract(seen, 'p=([0-9]*\.?[0-9]+)', 1) AS DOUBLE)
   WHEN regexp_matches(seen, '^\p{{Ll}}') THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.05 AS DOUBLE) END END AS p FROM c),
j AS (SELECT *, coalesce(p >= CASE WHEN regexp_matches(regexp_replace(prev, '[ \t]+$', ''), '[.!?:;…]["''”’)\]]*$') THEN 0.5 ELSE 0.2 END, FALSE) AS "join" FROM p),
u AS (SELECT *, CAST(sum(CASE WHEN "join" THEN 0 ELSE 1 END) OVER (PARTITION BY file ORDER BY num) AS BIGINT) AS para FROM j)"""
_WRAPPED = r"""
n AS (SELECT *, coalesce(lead("join") OVER w, FALSE) AS nj, lead(line) OVER w AS nl FROM u WINDOW w AS (PARTITION BY file ORDER BY num)),
o AS (SELECT *, CASE WHEN NOT "join" THEN line WHEN regexp_matches(prev, '^[ \t\f\r]*>') THEN regexp_replace(regexp_replace(regexp_replace(line, '^[ \t]+', ''), '^>', ''), '^[ \t]+', '')
   ELSE regexp_replace(line, '^[ \t]+', '') END AS own FROM n),
q AS (SELECT *, CASE WHEN NOT nj THEN own WHEN regexp_matches(regexp_replace(own, '[ \t]+$', ''), '\p{L}-$') AND regexp_matches(regexp_replace(nl, '^[ \t]+', ''), '^\p{Ll}')
   THEN regexp_replace(regexp_replace(own, '[ \t]+$', ''), '-$', '') ELSE concat(regexp_replace(own, '[ \t]+$', ''), ' ') END AS piece FROM o)"""
_TREE_SQL = """SELECT doc_id, CASE root WHEN 'log' THEN 'log/' || CASE WHEN contains(t, 'error') THEN 'error' ELSE 'warn' END
   WHEN 'mail' THEN 'mail/' || CASE WHEN contains(t, 'invoice') THEN 'invoice' ELSE 'order' END ELSE root END AS label, CAST(0.9 AS DOUBLE) AS confidence
 FROM (SELECT *, CASE WHEN contains(t, 'log') THEN 'log' WHEN contains(t, 'mail') THEN 'mail' ELSE 'other' END AS root FROM (SELECT doc_id, lower(coalesce({0}, '')) AS t FROM documents))""".format(_clean_sql("text"))


def _est_sql(t: str) -> str:
    parts = "".join(f" + len(regexp_extract_all(x, '{p}')) * CAST({T.WEIGHTS[k]} AS DOUBLE)" for k, p in (
        ("letter", "[A-Za-z]"), ("digit", "[0-9]"), ("space", r"[ \t\n]"), ("punct", r"[!-/:-@\[-`{-~]"), ("other", r"[^\x00-\x7F]")))
    return f"CAST(floor(CAST(0 AS DOUBLE){parts}) + 1 AS INT)"


def _test_sql(agg: str, verdict: str) -> str:
    return f"WITH {_DOCS} SELECT file, round(x, 9) AS p, {verdict} AS verdict FROM (SELECT file, {agg}(p) AS x, bool_or(coalesce(regexp_matches(text, '[^{_SPACE}]'), FALSE)) AS has_text FROM docs GROUP BY file)"


_YESNO = "CASE WHEN NOT has_text THEN 'error' WHEN x >= 0.5 THEN 'yes' ELSE 'no' END"
_GRID = ", ".join(str(t) for t in evaluate.GRID)
SQL = {
    "filter_basic": f"WITH {_DOCS} SELECT doc_id, p FROM docs WHERE p >= 0.5",
    "filter_invert": f"WITH {_DOCS} SELECT doc_id, p FROM docs WHERE NOT p >= 0.5",
    "filter_threshold": f"WITH {_DOCS} SELECT doc_id, p FROM docs WHERE p >= 0.9",
    "filter_band_verdicts": f"WITH {_DOCS} SELECT file, CASE WHEN p BETWEEN 0.3 AND 0.7 THEN 'uncertain' WHEN p > 0.7 THEN 'selected' ELSE 'rejected' END AS verdict, count(*) AS n FROM docs GROUP BY ALL",
    "filter_uncertain": f"WITH {_DOCS} SELECT doc_id, p FROM docs WHERE p BETWEEN 0.3 AND 0.7",
    "filter_count_per_source": f"WITH {_DOCS} SELECT file, count(*) FILTER (p >= 0.9) AS n FROM docs GROUP BY file",
    "filter_totals": f"WITH {_DOCS} SELECT count(*) FILTER (p >= 0.5) AS selected, count(*) FILTER (p < 0.5) AS rejected, CAST(0 AS BIGINT) AS uncertain, CAST(0 AS BIGINT) AS failed FROM docs",
    "filter_first": f"WITH {_DOCS} SELECT doc_id, p FROM docs WHERE p >= 0.5 ORDER BY doc_id LIMIT 25",
    "filter_context": f"""WITH {_DOCS}, n AS (SELECT *, max(CAST(p >= 0.9 AS INT)) OVER (PARTITION BY file ORDER BY num ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS near FROM docs),
      k AS (SELECT *, lag(num) OVER (PARTITION BY file ORDER BY num) AS pn FROM n WHERE near = 1)
      SELECT file, num, doc_id, p, p >= 0.9 AS match, (pn IS NULL OR pn <> num - 1) AND NOT (file = first_value(file) OVER o AND num = first_value(num) OVER o) AS gap
      FROM k WINDOW o AS (ORDER BY file, num)""",
    "filter_neighbours": f"WITH {_DOCS} SELECT doc_id, length(lag(text) OVER w) AS before, length(lead(text) OVER w) AS after FROM docs WHERE text IS NOT NULL WINDOW w AS (PARTITION BY file ORDER BY num)"
    + " UNION ALL SELECT NULL, NULL, NULL WHERE FALSE",
    "filter_fields": f"SELECT file, num, len(string_split(text, ',')) AS n FROM csv_rows WHERE contains(lower(concat({_clean_sql('text')}, ' ', coalesce(string_split(text, ',')[3], ''))), '.example')",
    "files_any_chunk": f"SELECT file, p, CAST(0 AS BIGINT) AS failed, CASE WHEN p >= 0.5 THEN 'selected' ELSE 'rejected' END AS verdict FROM (SELECT input_id AS file, max({_p_sql(_clean_sql('l'))}) AS p FROM (SELECT input_id, coalesce(unnest(lines), '') AS l FROM doc_inputs) GROUP BY 1)",
    "choose_labels": f"WITH {_NAMED_CTE} SELECT doc_id, coalesce(won, 'invoice') AS label, CASE WHEN won IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END AS confidence, CASE WHEN won IS NULL THEN 'uncertain' ELSE 'yes' END AS verdict"
    f" FROM (SELECT doc_id, coalesce(won, o) AS won FROM (SELECT n.doc_id, won, CASE WHEN contains(lower(coalesce({_clean_sql('text')}, '')), 'other') THEN 'other' END AS o FROM named n JOIN documents d ON n.doc_id = d.doc_id)) WHERE won IS NULL OR won <> 'other'"
    f" UNION ALL SELECT doc_id, 'other', CAST(0.8 AS DOUBLE), 'no' FROM (SELECT n.doc_id, won, contains(lower(coalesce({_clean_sql('text')}, '')), 'other') AS o FROM named n JOIN documents d ON n.doc_id = d.doc_id) WHERE won IS NULL AND o",
    "choose_probs": f"""WITH {_NAMED_CTE}, o AS (SELECT unnest(['invoice', 'error', 'review', 'build']) AS label, unnest([0, 1, 2, 3]) AS i),
      x AS (SELECT doc_id, label, i, CASE WHEN won IS NULL THEN CAST(0.25 AS DOUBLE) WHEN won = label THEN CAST(0.9 AS DOUBLE) ELSE (1 - CAST(0.9 AS DOUBLE)) / 3 END AS p FROM named, o)
      SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, i) AS place, label, round(p, 9) AS p FROM x""",
    "label_basic": f"WITH {_NAMED_CTE} SELECT doc_id, coalesce(won, 'invoice') AS label, CASE WHEN won IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(0.8 AS DOUBLE) END AS confidence FROM named",
    "label_unsure": f"WITH {_NAMED_CTE} SELECT doc_id, coalesce(won, '?') AS label FROM named",
    "label_only": f"WITH {_NAMED_CTE} SELECT doc_id, coalesce(won, '?') AS label FROM named WHERE coalesce(won, '?') IN ('error', '?')",
    "label_counts": f"WITH {_NAMED_CTE} SELECT label, n, row_number() OVER (ORDER BY f) AS place FROM (SELECT coalesce(won, '?') AS label, count(*) AS n, min(doc_id) AS f FROM named GROUP BY 1)",
    "label_priorities": "SELECT CASE WHEN contains(t, 'urgent') THEN 'urgent' WHEN contains(t, 'high') THEN 'high' WHEN contains(t, 'medium') THEN 'medium' WHEN contains(t, 'low') THEN 'low' WHEN contains(t, 'not') THEN 'not' ELSE 'other' END AS label, count(*) AS n FROM (SELECT lower(o_orderpriority) AS t FROM orders) GROUP BY 1",
    "label_tree": _TREE_SQL,
    "rank_score": f"WITH {_DOCS} SELECT doc_id, p AS score FROM docs ORDER BY p DESC, doc_id LIMIT 200",
    "rank_worst": f"WITH {_DOCS} SELECT doc_id, p AS score FROM docs ORDER BY p, doc_id LIMIT 50",
    "rank_levels": "SELECT p_partkey, score FROM (SELECT p_partkey, CASE WHEN p_size % 6 <= 3 THEN CAST(p_size % 6 AS DOUBLE) ELSE CAST(1.5 AS DOUBLE) END AS score FROM part) ORDER BY score DESC, p_partkey LIMIT 300",
    "sort_seed": "SELECT CAST(n_nationkey AS BIGINT) AS num, row_number() OVER (ORDER BY seed, n_nationkey) - 1 AS pos, seed FROM (SELECT n_nationkey, CAST(least(4, (n_nationkey * 7 + 3) % 25 // 5) AS DOUBLE) AS seed FROM nation)",
    "sort_full": "SELECT CAST(n_nationkey AS BIGINT) AS num, row_number() OVER (ORDER BY (n_nationkey * 7 + 3) % 25) - 1 AS pos FROM nation",
    "pick_best": f"WITH {_DOCS}, r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY p DESC, num) AS place, max(p) OVER (PARTITION BY file) AS top FROM docs WHERE regexp_matches(text, '[^{_SPACE}]')) SELECT file, place, num, p, 'yes' AS verdict FROM r WHERE place <= 2 AND top >= 0.5",
    "pick_windows": f"WITH {_DOCS}, r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY p DESC, num) AS place FROM docs WHERE regexp_matches(text, '[^{_SPACE}]')) SELECT file, place, num, p FROM r WHERE place <= 3",
    "segment_events": """WITH r AS (SELECT user_id, event_type AS text, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS num FROM events),
      s AS (SELECT *, CASE WHEN num > 1 THEN CASE WHEN contains(text, 'signup') THEN CAST(0.95 AS DOUBLE) ELSE CAST(0.05 AS DOUBLE) END END AS p FROM r),
      g AS (SELECT *, 1 + CAST(sum(CASE WHEN coalesce(p, 0) >= 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY num) AS BIGINT) AS segment FROM s)
      SELECT user_id, segment, count(*) AS n, min(num) AS "first", max(num) AS "last", (list(p ORDER BY num))[1] AS p FROM g GROUP BY ALL""",
    "unwrap_lines": f'WITH {_UNWRAP} SELECT file, num, kind, p, "join", para FROM u',
    "unwrap_docs": f"WITH {_UNWRAP}, {_WRAPPED} SELECT file, min(num) AS num, count(*) AS n, string_agg(piece, '' ORDER BY num) AS text FROM q GROUP BY file, para",
    "edit_squeeze": _edit_sql("regexp_replace(regexp_replace(regexp_replace(l, '!{2,}', '!', 'g'), '={2,}', '=', 'g'), '-{2,}', '-', 'g')"),
    "edit_delete": _edit_sql("regexp_replace(l, '[0-9]+', '', 'g')"),
    "edit_translate": _edit_sql("translate(l, 'abc', 'ABC')"),
    "edit_regex": _edit_sql(r"regexp_replace(l, '([A-Z]+)-([0-9]+)', '\2/\1', 'g')"),
    "bisect_flip": "SELECT pos, o_orderkey FROM (SELECT o_orderkey, o_orderdate, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders) WHERE o_orderdate >= TIMESTAMP '1995-06-17' ORDER BY pos LIMIT 1",
    "bisect_invert": "SELECT pos, event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events) WHERE event_id >= 333 ORDER BY pos LIMIT 1",
    "columns_by_description": "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer",
    "probe_columns": f"""SELECT doc_id, CASE WHEN regexp_extract(t, 'p=([0-9]*\\.?[0-9]+)', 1) <> '' THEN CAST(regexp_extract(t, 'p=([0-9]*\\.?[0-9]+)', 1) AS DOUBLE) WHEN contains(t, 'yes') THEN CAST(0.95 AS DOUBLE) WHEN contains(t, 'maybe') THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.05 AS DOUBLE) END AS problem,
      CASE WHEN contains(t, 'invoice') THEN 'invoice' WHEN contains(t, 'error') THEN 'error' WHEN contains(t, 'review') THEN 'review' ELSE 'invoice' END AS topic,
      CASE WHEN contains(t, 'invoice') OR contains(t, 'error') OR contains(t, 'review') THEN CAST(0.8 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS topic_conf,
      CASE WHEN lv <= 2 THEN CAST(lv AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS heat
      FROM (SELECT doc_id, lower(t0) AS t, TRY_CAST(regexp_extract(lower(t0), 'level=([0-9]{{1,3}})', 1) AS INT) AS lv FROM (SELECT doc_id, {_clean_sql("concat(coalesce(text, ''), ' level=', doc_id % 4)")} AS t0 FROM documents))""",
    "probe_json": """SELECT event_id, '{"record":' || props || ',"answers":{"seven":' || CASE WHEN contains(props, '7') THEN '0.9' ELSE '0.05' END || ',"size":1.0}}' AS json FROM events WHERE trim(props) <> ''""",
    "tree_nodes": """WITH f AS (SELECT DISTINCT file FROM documents WHERE file IS NOT NULL), s AS (SELECT string_split(file, '/') AS x, unnest(range(1, len(string_split(file, '/')) + 1)) AS n FROM f)
      SELECT array_to_string(x[1:n], '/') AS path, coalesce(array_to_string(x[1:n - 1], '/'), '') AS parent, x[n] AS name, bool_or(n < len(x)) AS is_dir, count(DISTINCT array_to_string(x, '/')) AS files FROM s GROUP BY 1, 2, 3""",
    "quote_tokens": f"SELECT doc_id, {_est_sql('x')} AS tokens FROM (SELECT doc_id, {_plain_sql(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS x FROM documents)",
    "text_clean": rf"""SELECT file, num, text, CASE WHEN length(text) > 40 THEN substring(text, 1, 39) || '…' ELSE text END AS clipped FROM (
      SELECT input_id AS file, num, {_clean_sql('line')} AS text FROM (SELECT input_id, num, regexp_replace(coalesce(l, ''), '\r$', '') AS line FROM (SELECT input_id, unnest(lines) AS l, unnest(range(1, len(lines) + 1)) AS num FROM doc_inputs)))""",
    "ledger_by_day": f"SELECT s.day, coalesce(CAST(sum(CAST(usd AS DECIMAL(24, 6))) AS DOUBLE), 0) AS usd FROM (SELECT unnest(generate_series(DATE '{LAST}' - 89, DATE '{LAST}', INTERVAL 1 DAY))::DATE AS day) s LEFT JOIN ledger l ON s.day = l.day GROUP BY 1",
    "ledger_by_tool": f"SELECT tool, CAST(sum(CAST(coalesce(usd, 0) AS DECIMAL(24, 6))) AS DOUBLE) AS usd, CAST(sum(coalesce(tokens, 0)) AS BIGINT) AS tokens FROM ledger WHERE strftime(day, '%Y-%m') = '{MONTH}' GROUP BY tool",
    "ledger_spent": "SELECT coalesce(CAST(sum(CAST(usd AS DECIMAL(24, 6))) FILTER (day = DATE '2026-09-14') AS DOUBLE), 0) AS today, coalesce(CAST(sum(CAST(usd AS DECIMAL(24, 6))) FILTER (strftime(day, '%Y-%m') = '2026-09') AS DOUBLE), 0) AS month FROM ledger",
    "ledger_merged": f"SELECT day, tool, round(sum(u), 6) AS usd, CAST(sum(t) AS BIGINT) AS tokens FROM (SELECT day, tool, coalesce(usd, 0) AS u, coalesce(tokens, 0) AS t FROM ledger WHERE day < DATE '2026-10-01' UNION ALL SELECT day, tool, coalesce(usd, 0), coalesce(tokens, 0) FROM ledger WHERE day >= DATE '2026-09-15') WHERE day >= DATE '{LAST - dt.timedelta(days=ledger.RETENTION)}' GROUP BY ALL",
    "eval_metrics": f"""WITH {_DOCS}, x AS (SELECT p, CAST(file IN ('app-log', 'ci-log', 'alerts') AS INT) AS y FROM docs), g AS (SELECT unnest([{_GRID}]) AS t),
      a AS (SELECT CAST(t AS DOUBLE) AS t, avg(CAST((p >= t) = (y = 1) AS INT)) AS acc FROM x, g GROUP BY t), h AS (SELECT avg(CAST((p >= 0.5) = (y = 1) AS INT)) AS acc FROM x),
      k AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM x GROUP BY p), w AS (SELECT pos * (coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2) AS won FROM k)
      SELECT (SELECT count(*) FROM x) AS n, (SELECT CAST(sum(y) AS BIGINT) FROM x) AS positives, round(h.acc, 9) AS accuracy,
        round(CASE WHEN (SELECT max(acc) FROM a) > h.acc THEN (SELECT min(t) FROM a WHERE acc = (SELECT max(acc) FROM a)) ELSE 0.5 END, 9) AS best_threshold, round(greatest(h.acc, (SELECT max(acc) FROM a)), 9) AS best_accuracy,
        round((SELECT sum(won) FROM w) / (SELECT CAST(sum(pos) AS DOUBLE) * sum(neg) FROM k), 9) AS auc, round((SELECT avg(p) FROM x WHERE y = 1), 9) AS mean_pos, round((SELECT avg(p) FROM x WHERE y = 0), 9) AS mean_neg FROM h""",
    "records_lines": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i, len(string_split(text, chr(10))) AS n FROM documents WHERE text IS NOT NULL)
      SELECT doc_id, count(*) AS n, max(length(CASE WHEN i < n THEN regexp_replace(l, '\r$', '') ELSE l END)) AS longest FROM l WHERE NOT (i = n AND l = '') GROUP BY doc_id""",
    "records_paragraphs": r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '^[\r\n]+', ''), '[\r\n]+$', '') AS t FROM documents), s AS (SELECT doc_id, regexp_split_to_array(t, '\r*\n\r?\n[\r\n]*') AS a FROM t WHERE t <> '')
      SELECT doc_id, num, length(x) AS n FROM (SELECT doc_id, unnest(a) AS x, unnest(range(1, len(a) + 1)) AS num FROM s)""",
    "test_any": _test_sql("max", _YESNO), "test_all": _test_sql("min", _YESNO), "test_mean": _test_sql("avg", _YESNO),
    "test_band": _test_sql("max", "CASE WHEN NOT has_text THEN 'error' WHEN x BETWEEN 0.6 AND 0.9 THEN 'uncertain' WHEN x > 0.9 THEN 'no' ELSE 'yes' END"),
    "collapse_first": f"WITH {_RUNS} SELECT user_id, run, n, num, text FROM h",
    "collapse_repeated": f"WITH {_RUNS} SELECT user_id, run, n, num, text FROM h WHERE n > 1",
    "collapse_unique": f"WITH {_RUNS} SELECT user_id, run, n, num, text FROM h WHERE n = 1",
    "collapse_all": f"WITH {_RUNS} SELECT g.user_id, g.run, h.n, g.num, g.text FROM g JOIN h ON g.user_id = h.user_id AND g.run = h.run WHERE h.n > 1",
}
SQL["filter_neighbours"] = f"WITH {_DOCS}, x AS (SELECT * FROM docs) SELECT doc_id, length(lag(text) OVER w) AS before, length(lead(text) OVER w) AS after FROM x WINDOW w AS (PARTITION BY file ORDER BY num)"
SQL["stream_filter"], SQL["stream_label"] = SQL["filter_basic"], SQL["label_unsure"]
