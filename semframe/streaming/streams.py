"""Record operators over Structured Streaming.

Filter, label and probe are projections: the batch functions work on a stream with an expression judge.  Collapse, segment
and unwrap need the record before; they keep a small state per input with ``applyInPandasWithState`` and give what the batch
operators give.  Their judge is a function from pairs of texts to probabilities.

A stream has no end.  What is still open is given out when a row with ``eof = true`` arrives for the input, or, with
``idle_ms``, when nothing has come for so long; a record after that starts afresh.  A query with ``idle_ms`` waits for time to
pass, so it does not end under ``availableNow``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType, StructField, StructType

from semframe.operators import unwrap as lines_
from semframe.plans.judge import Refused

PairJudge = Callable[[list[tuple[str, str]]], list[float | None]]
#: Input of the stateful forms; ``eof`` may be null.
INPUT = "file string, num bigint, text string, eof boolean"


def same_first_word(pairs: list[tuple[str, str]]) -> list[float]:
    words = [(a.lower().split()[:1], b.lower().split()[:1]) for a, b in pairs]
    return [0.95 if a and a == b else 0.05 for a, b in words]


def equal_texts(pairs: list[tuple[str, str]]) -> list[float]:
    return [0.95 if a == b else 0.05 for a, b in pairs]


def new_marker(pairs: list[tuple[str, str]]) -> list[float]:
    return [0.95 if "NEW" in b else 0.05 for _, b in pairs]


def lowercase_start(pairs: list[tuple[str, str]]) -> list[float]:
    return [0.9 if b.lstrip(" \t>")[:1].islower() else 0.05 for _, b in pairs]


def judged_pairs(handler, wording: str, limit: int = 128) -> PairJudge:
    """Pairs judged by a handler of packed requests, ``limit`` questions a request; a failed pair is None: no run goes on, no
    segment begins, no line is joined."""

    def judge(pairs: list[tuple[str, str]]) -> list[float | None]:
        out: list[float | None] = []
        for lo in range(0, len(pairs), limit):
            qs = [{"type": "noul", "instructions": {"f1": a, "f2": b, "question": wording}, "criteria": None} for a, b in pairs[lo : lo + limit]]
            try:
                answers = handler({"state": "Answer each question about the record it contains.", "questions": qs})
            except Refused:
                raise
            except Exception:  # noqa: BLE001
                answers = [{"error": "failed"}] * len(qs)
            out += [None if a.get("error") else a.get("noul") for a in answers]
        return out

    return judge


def _records(parts: Iterator[pd.DataFrame]) -> tuple[list[tuple[int, str]], bool]:
    """One micro-batch of one input: its records in order, and whether it has ended.  Plain lists, as most inputs are too short
    to pay for sorting and selecting in pandas."""
    rows, ended = [], False
    for part in parts:
        for n, t, end in zip(*[part[c].tolist() for c in ("num", "text", "eof")]):
            if end is not None and end == end and end:
                ended = True
            else:
                rows.append((int(n), "" if t is None or t != t else t))
    rows.sort(key=lambda r: r[0])
    return rows, ended


def _stateful(stream: DataFrame, fold, out: str, state: str, idle_ms: int | None) -> DataFrame:
    """``fold(file, rows, state or None, ended) -> (output rows, state or None)`` per input and micro-batch."""
    names = [x.split()[0] for x in out.split(", ")]

    def run(key: tuple, parts: Iterator[pd.DataFrame], st: GroupState) -> Iterator[pd.DataFrame]:
        now = st.get if st.exists else None
        if st.hasTimedOut:
            rows, ended = [], True
        else:
            rows, ended = _records(parts)
        given, new = fold(key[0], rows, now, ended)
        if new is None:
            if st.exists:
                st.remove()
        else:
            st.update(new)
            if idle_ms is not None:
                st.setTimeoutDuration(idle_ms)
        if given:
            yield pd.DataFrame(dict(zip(names, map(list, zip(*given)))))

    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return stream.groupBy("file").applyInPandasWithState(run, out, state, "append", timeout)


def stream_neighbours(stream: DataFrame, n: int, idle_ms: int | None = None) -> DataFrame:
    """``file, num, text, before, after``: each record with up to ``n`` texts on either side (null instead of empty), given out when
    the records after it have come, or at the end.  A batch filter with neighbours, or any other question, follows on it."""

    def fold(file, rows, state, ended):
        past, waiting = json.loads(state[0]) if state else ([], [])
        texts = past + [t for _, t in waiting] + [t for _, t in rows]
        todo = [*waiting, *rows]
        ready = len(todo) if ended else max(0, len(todo) - n)
        out = []
        for i, (num, text) in enumerate(todo[:ready], len(past)):
            out.append((file, num, text, texts[max(0, i - n) : i] or None, texts[i + 1 : i + 1 + n] or None))
        if ended:
            return out, None
        keep = len(past) + ready
        return out, (json.dumps((texts[max(0, keep - n) : keep], todo[ready:])),) if texts else None

    return _stateful(stream, fold, "file string, num bigint, text string, before array<string>, after array<string>", "kept string", idle_ms)


def stream_collapse(stream: DataFrame, judge: PairJudge, threshold: float = 0.5, idle_ms: int | None = None) -> DataFrame:
    """Heads of runs with their length, as each run ends: ``file, num, n, text, p``."""

    def fold(file, rows, state, ended):
        out = []
        last, num, head, p, n = state or (None, 0, None, None, 0)
        texts = ([last] if n else []) + [t for _, t in rows]
        ps = judge(list(zip(texts, texts[1:]))) if len(texts) > 1 else []
        ps = ps if n else [None, *ps] if rows else []
        for (k, t), q in zip(rows, ps):
            if n and q is not None and q >= threshold:
                n += 1
            else:
                if n:
                    out.append((file, num, n, head, p))
                num, head, p, n = k, t, q, 1
            last = t
        if ended:
            if n:
                out.append((file, num, n, head, p))
            return out, None
        return out, ((last, num, head, p, n) if n else None)

    return _stateful(stream, fold, "file string, num bigint, n bigint, text string, p double", "last string, num bigint, head string, p double, n bigint", idle_ms)


def stream_segment(stream: DataFrame, judge: PairJudge, threshold: float = 0.5, min_len: int = 1, idle_ms: int | None = None) -> DataFrame:
    """Every record with the boundary before it: ``file, num, text, p, cut, segment``."""

    def fold(file, rows, state, ended):
        last, since, segment = state or (None, 0, 1)
        texts = ([last] if since else []) + [t for _, t in rows]
        ps = judge(list(zip(texts, texts[1:]))) if len(texts) > 1 else []
        ps = ps if since else [None, *ps] if rows else []
        out = []
        for (k, t), q in zip(rows, ps):
            cut = bool(since) and q is not None and q >= threshold and since >= min_len
            segment += cut
            since = 1 if cut else since + 1
            out.append((file, k, t, q, cut, segment))
            last = t
        return out, None if ended or not since else (last, since, segment)

    return _stateful(stream, fold, "file string, num bigint, text string, p double, cut boolean, segment bigint", "last string, since bigint, segment bigint", idle_ms)


def _py(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace("\\z", "\\Z").replace("\\p{L}", "[^\\W\\d_]"))


_FENCE, _QUOTE, _TERMINAL, _HYPHEN = (_py(p) for p in (lines_.FENCE, lines_.QUOTE, lines_.TERMINAL, lines_.HYPHEN))
_FIXED = [_py(p) for p in (lines_.FENCE, lines_.HEADING, lines_.RULE, lines_.TABLE)]
_ITEM = _py(lines_.LIST_ITEM)


def _kind(line: str, in_fence: bool) -> str:
    if not line.strip():
        return lines_.BLANK
    if in_fence or line.startswith(("\t", "    ")) or any(p.search(line) for p in _FIXED):
        return lines_.FIXED
    return lines_.STARTS if _ITEM.search(line) or _QUOTE.search(line) else lines_.PLAIN


def stream_unwrap(stream: DataFrame, judge: PairJudge, separator: str = " ", dehyphen: bool = False, dangling: float = lines_.DANGLING_T,
                  terminal: float = lines_.TERMINAL_T, idle_ms: int | None = None) -> DataFrame:
    """Rejoined lines as soon as the next one does not join: ``file, num, n, text``."""

    def fold(file, rows, state, ended):
        # text: what is joined so far, without its last line; own: the last line as it will be written; line: as it came
        num, n, text, own, line, kind, fence = state or (0, 0, "", "", "", "", False)
        out, decided = [], []
        before, kb, f = line, kind, fence
        for k, t in rows:
            kt = _kind(t, f)
            f ^= bool(_FENCE.search(t))
            open_ = bool(kb) and kt not in (lines_.BLANK, lines_.FIXED) and kb not in (lines_.BLANK, lines_.FIXED)
            open_ &= kt != lines_.STARTS or bool(_QUOTE.search(t) and _QUOTE.search(before))
            decided.append((k, t, kt, f, before, open_))
            before, kb = t, kt
        ps = iter(judge([(b, t) for _, t, _, _, b, o in decided if o])) if any(d[5] for d in decided) else iter(())
        for k, t, kt, f2, b, open_ in decided:
            p = next(ps) if open_ else None
            join = p is not None and p >= (terminal if _TERMINAL.search(b.rstrip(" \t")) else dangling)
            if join:
                cut = own.rstrip(" \t")
                if dehyphen and _HYPHEN.search(cut) and t.lstrip(" \t")[:1].islower():
                    text += cut[:-1]
                else:
                    text += cut + separator
                own = t.lstrip(" \t")
                if _QUOTE.search(b):
                    own = own.removeprefix(">").lstrip(" \t")
                n += 1
            else:
                if n:
                    out.append((file, num, n, text + own))
                num, n, text, own = k, 1, "", t
            line, kind, fence = t, kt, f2
        if ended:
            if n:
                out.append((file, num, n, text + own))
            return out, None
        return out, (num, n, text, own, line, kind, fence) if n else None

    return _stateful(stream, fold, "file string, num bigint, n bigint, text string", "num bigint, n bigint, text string, own string, line string, kind string, fence boolean", idle_ms)


def drain(df: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there now into a table on shared storage, beside the checkpoint, that is also the view ``name``.

    The executors write the rows, so nothing of the result goes through the driver, and a stream that is drained again adds what
    has come since."""
    spark, where = df.sparkSession, f"{checkpoint.rstrip('/')}-rows"
    void = [f.name for f in df.schema.fields if f.dataType.typeName() == "void"]  # a file has no such column
    df.withColumns({c: F.col(c).cast("string") for c in void}).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(where).awaitTermination()
    kept = StructType([StructField(f.name, StringType() if f.name in void else f.dataType) for f in df.schema.fields])
    out = spark.read.schema(kept).parquet(where).withColumns({c: F.lit(None) for c in void})
    out.createOrReplaceTempView(name)
    return out


def stop_after(df: DataFrame, n: int, checkpoint: str, by: tuple[str, ...] = ("file_idx", "num")) -> list:
    """The first ``n`` rows a stream gives, then the query is stopped: nothing more is read or spent."""
    got: list = []

    def take(batch: DataFrame, _: int) -> None:
        if len(got) < n:
            got.extend(batch.orderBy(*[c for c in by if c in batch.columns]).limit(n - len(got)).collect())

    q = df.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(processingTime="250 milliseconds").start()
    try:
        while q.isActive and len(got) < n:
            if q.awaitTermination(1):
                break
            progress = q.lastProgress
            if progress and progress["numInputRows"] == 0 and not q.status["isDataAvailable"] and not q.status["isTriggerActive"]:
                break
    finally:
        q.stop()
    return got[:n]
