"""Requests about a document: consecutive records under ids, with all questions about them in one request.

A judge by packed requests sees a window of records as ``L0001| text`` lines and is asked about the ids, so it knows the
surroundings and the records are paid for once.  Windows are filled in order up to a number of records and of tokens; a window
is one row, so nothing larger than a request is ever gathered.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semframe.functions.text import clean, estimate, estimate_json_plain, tagged_id
from semframe.operators.sequence import numbered, over_neighbours
from semframe.plans.judge import BatchJudge, Limits
from semframe.plans.planner import packed_requests


def windowed(records: DataFrame, group: Sequence[str], size: int, tokens: int | None, text: Column | str = "_text") -> DataFrame:
    """``window``: consecutive records, at most ``size`` of them and of at most ``tokens`` tokens together; a longer record has a
    window of its own.  Each window is filled before the next begins."""
    if tokens is None:
        return numbered(records, group, ["num"], "_k").withColumn("window", F.floor((F.col("_k") - 1) / size)).drop("_k")
    limits = Limits(request_tokens=tokens, question_tokens=tokens, margin=1.0, questions=size, frame=0, per_question=0)
    sized = records.withColumn("_est", estimate(F.col(text) if isinstance(text, str) else text)).withColumn("_none", F.lit(0))
    return packed_requests(sized, state_est="_none", est="_est", group=list(group), by=["num"], limits=limits).withColumnRenamed("request", "window").drop("_est", "_none")


def documents(rows: DataFrame, group: Sequence[str], window: str = "window", text: Column | str = "_text", prefix: str = "L", asked: Column | None = None,
              whole: bool = False) -> DataFrame:
    """``group, window, document, lines``: the records of each window as ``L0001| text`` lines, numbered from 1 within the window
    (blank ones left blank, line ends within a record as blanks), and ``lines``: ``num, tag, asked`` of each, with ``whole`` also
    ``row``, its other columns."""
    one_line = F.regexp_replace(text, "[\\r\\n]+", " ")
    others = [c for c in rows.columns if c not in (*group, window, "num")] if whole else []
    row = [F.struct(*others).alias("row")] if others else []
    shown = F.sort_array(F.collect_list(F.struct("num", one_line.alias("text"), (F.lit(True) if asked is None else asked).alias("asked"), *row)))
    got = rows.groupBy(*group, window).agg(shown.alias("_l"))
    tag = lambda i: tagged_id(prefix, i + 1)
    line = F.transform("_l", lambda x, i: F.when(x["text"].rlike("(?U)\\S"), F.concat(tag(i), F.lit("| "), x["text"])).otherwise(""))
    lines = F.transform("_l", lambda x, i: F.struct(x["num"].alias("num"), tag(i).alias("tag"), x["asked"].alias("asked"), *([x["row"].alias("row")] if row else [])))
    return got.select(*group, window, F.array_join(line, "\n").alias("document"), lines.alias("lines"))


def state_of(context: dict[str, str] | None) -> Column:
    """The document with what the run says about it."""
    return F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in (context or {}).items()], F.col("document")))


def question(key: Column, kind: str, text: Column, criteria: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(key.alias("key"), F.lit(kind).alias("type"), F.to_json(F.struct(text.alias("question"))).alias("instructions"), (none if criteria is None else criteria).alias("criteria"))


def choose_in_windows(rows: DataFrame, judge: BatchJudge, wording: str, exists: str | None, group: Sequence[str], context: dict[str, str] | None = None, text: Column | str = "_text") -> DataFrame:
    """``rows`` with ``p``, the share of each record in the choice of its window, and ``exists``, whether the window holds an answer
    at all (null unless asked).  A window refused as too large is halved; a failed one has p null.

    The records go along with their window, so nothing is joined back to them."""
    parts: list[DataFrame] = []
    columns = [c for c in rows.columns if c not in (*group, "window", "num")]
    todo = rows.withColumn("window", F.col("window").cast("string"))
    while True:
        docs = documents(todo, group, text=text, whole=True)
        options = F.to_json(F.map_from_arrays(F.transform("lines", lambda x: x["tag"]), F.transform("lines", lambda x: F.lit(""))))
        asked = [question(F.lit("best"), "choice", F.lit(wording), options)]
        if exists is not None:
            asked.append(question(F.lit("exists"), "noul", F.lit(exists)))
        got = judge.attach_windows(docs.withColumn("state", state_of(context)).withColumn("questions", F.array(*asked)).drop("document"))
        best = F.get(F.filter("answers", lambda a: a["key"] == "best"), 0)
        there = F.get(F.filter("answers", lambda a: a["key"] == "exists"), 0)
        one = got.select(*group, "window", best["probabilities"].alias("_probs"), best["error"].alias("_error"), there["noul"].alias("exists"), F.size("lines").alias("_n"), F.posexplode("lines").alias("_i", "_line"))
        # a window that is too large is asked in halves; a single record that is, is skipped
        large = F.coalesce(F.col("_error").startswith("too large"), F.lit(False)) & (F.col("_n") > 1)
        p = F.when(F.col("_probs").isNotNull(), F.coalesce(F.try_element_at("_probs", F.col("_line.tag")), F.lit(0.0)))
        record = [*group, F.col("_line.num").alias("num"), *[F.col("_line.row")[c].alias(c) for c in columns]]
        parts.append(one.where(~large).select(*record, "window", p.alias("p"), "exists"))
        half = F.concat("window", F.when(F.col("_i") * 2 < F.col("_n"), ".0").otherwise(".1")).alias("window")
        todo = one.where(large).select(*record, half)
        if todo.isEmpty():
            break
    answers = parts[0]
    for x in parts[1:]:
        answers = answers.unionByName(x)
    return answers.select(*rows.columns, "p", "exists")


def asking_choices(judge: BatchJudge, wording: str, exists: str, context: dict[str, str] | None = None) -> Callable:
    """``choose_in_windows`` within a worker: what a worker makes itself a function of, from windows, each the cleaned texts of its
    records, none of them blank, and whether to ask if there is an answer, to ``(p of each, exists)`` of each window or its halves."""
    dumped = lambda x: json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    best, there = ({"key": k, "type": t, "instructions": dumped({"question": w}), "criteria": None} for k, t, w in (("best", "choice", wording), ("exists", "noul", exists)))
    answering, there_est, line_ends = judge.answering(), estimate_json_plain(there["instructions"]), re.compile("[\\r\\n]+")

    def make():
        answered = answering()
        #: by the number of lines, as all else of these questions is alike
        choices: dict[int, tuple[list[str], dict, int]] = {}

        def choice(n: int) -> tuple[list[str], dict, int]:
            if n not in choices:
                tags = [f"L{i:04d}" for i in range(1, n + 1)]
                asked = best | {"criteria": dumped(dict.fromkeys(tags, ""))}
                choices[n] = tags, asked, estimate_json_plain(asked["instructions"] + asked["criteria"])
            return choices[n]

        def request(texts: list[str], first: bool) -> tuple:
            tags, asked, est = choice(len(texts))
            document = "\n".join([f"{tag}| {line_ends.sub(' ', t)}" for tag, t in zip(tags, texts)])
            state = dumped({**(context or {}), "document": document})
            return state, [asked, there] if first else [asked], estimate_json_plain(state), [est, there_est] if first else [est]

        def ask(windows: list[list[str]], first: bool) -> list[list[tuple[list[float | None], float | None]]]:
            out: list[list] = [[] for _ in windows]
            halves, of = [], []
            for i, (texts, got) in enumerate(zip(windows, answered([request(texts, first) for texts in windows]))):
                if len(texts) > 1 and (got[0]["error"] or "").startswith("too large"):
                    half = -(-len(texts) // 2)
                    halves += [texts[:half], texts[half:]]
                    of += [i, i]
                    continue
                share = None if got[0]["probabilities"] is None else dict(got[0]["probabilities"])
                out[i].append(([None if share is None else float(share.get(tag) or 0.0) for tag in choice(len(texts))[0]], got[1]["noul"] if first else None))
            for i, parts in zip(of, ask(halves, first) if halves else []):
                out[i] += parts
            return out

        return ask

    return make


def ask_at_breaks(rows: DataFrame, judge: BatchJudge, condition: Column, wording: Callable[[Column], Column], *, group: Sequence[str], text: str, size: int, tokens: int,
                  prefix: str, around: int = 0, yes: str | None = None, no: str | None = None, context: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with ``_answer`` (``noul, error``) on the break before each record that fulfils ``condition``, null elsewhere.

    A window's document also shows the record before it, and ``around`` further ones on either side."""
    shown = windowed(rows.select(*group, "num", clean(F.col(text)).alias("_text"), F.coalesce(condition, F.lit(False)).alias("_ask")), group, size, tokens)
    reach = around + 1
    near = lambda w: F.array_distinct(F.filter(F.array(*[F.lead("window", k).over(w) for k in range(-around, reach + 1)]), lambda x: x.isNotNull()))
    copies = over_neighbours(shown, {"_docs": near}, reach, group).withColumn("doc", F.explode("_docs"))
    docs = documents(copies, group, "doc", prefix=prefix, asked=F.col("_ask") & (F.col("doc") == F.col("window")))
    criteria = F.lit(json.dumps({k: v for k, v in (("true", yes), ("false", no)) if v}, ensure_ascii=False)) if yes or no else None
    asked = F.transform(F.filter("lines", lambda x: x["asked"]), lambda x: question(x["num"].cast("string"), "noul", wording(x["tag"]), criteria))
    some = docs.withColumn("questions", asked).where(F.size("questions") > 0).withColumn("state", state_of(context)).drop("document", "lines")
    got = judge.attach_windows(some).select(*group, F.explode("answers").alias("_a"))
    answers = got.select(*group, F.col("_a.key").cast("bigint").alias("num"), F.struct(F.col("_a.noul").alias("noul"), F.col("_a.error").alias("error")).alias("_answer"))
    return rows.join(answers, [*group, "num"], "left")
