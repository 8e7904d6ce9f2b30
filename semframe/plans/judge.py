"""Judges: what turns questions about rows into probabilities.

An operator builds an ``Ask`` (the kind of question and the columns it is about) and calls ``judge.attach``.

* ``ExprJudge`` answers with a Catalyst expression: the operator stays one lazy plan.
* ``BatchJudge`` answers with a Python function over batches of encoded questions, packed into requests by state and size;
  its answers are written to shared storage once, because a judge may cost money and a lazy plan may be run again.

Answers are one struct column: ``noul, choice, score, confidence, probabilities, error``.  A failed question has a non-null
``error`` and is never dropped silently.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from semframe.functions.templates import Label
from semframe.functions.text import clean, estimate_json
from semframe.session import durable

ANSWER = "struct<noul:double,choice:string,score:double,confidence:double,probabilities:map<string,double>,error:string>"


@dataclass(frozen=True)
class Ask:
    """One question per row.

    ``about`` maps the names a question may use (text, f1, before, after, a, b, document, …) to columns, in the order in
    which they are encoded.  ``options`` and ``levels`` belong to choices and scores.
    """

    kind: str
    question: str
    about: Mapping[str, Column]
    options: tuple[Label, ...] = ()
    levels: tuple[str, ...] = ()
    yes: str | None = None
    no: str | None = None
    context: Mapping[str, str] = field(default_factory=dict)

    def subject(self) -> Column:
        """The text a rule looks at: the text and its fields, else the document, input or whatever comes first."""
        if "text" in self.about:
            parts = [self.about["text"]] + [c for n, c in self.about.items() if n[0] == "f" and n[1:].isdigit()]
            return F.concat_ws(" ", *parts) if len(parts) > 1 else parts[0]
        for name in ("document", "input"):
            if name in self.about:
                return self.about[name]
        return next(iter(self.about.values()))

    def instructions(self) -> Column:
        """The question as a JSON object with the keys in order; empty lists and nulls are left out."""
        parts = []
        for name, c in self.about.items():
            parts.append(c.alias(name))
        order = [p for p in parts] + [F.lit(self.question).alias("question")]
        return F.to_json(F.struct(*order))

    def criteria(self) -> str | None:
        """What the answers mean, as JSON; null for a yes/no question that says nothing."""
        if self.kind == "choice":
            return json.dumps({o.name: o.description or "" for o in self.options}, ensure_ascii=False)
        if self.kind == "score":
            return json.dumps(list(self.levels), ensure_ascii=False)
        if self.yes or self.no:
            return json.dumps({k: v for k, v in (("true", self.yes), ("false", self.no)) if v}, ensure_ascii=False)
        return None

    def state(self) -> str:
        """What the questions of one request share."""
        return json.dumps(dict(self.context), ensure_ascii=False) if self.context else '"Answer each question about the record it contains."'


def answer(noul: Column | None = None, choice: Column | None = None, score: Column | None = None, confidence: Column | None = None,
           probabilities: Column | None = None, error: Column | None = None) -> Column:
    """An answer struct with the parts given."""
    d, s = F.lit(None).cast("double"), F.lit(None).cast("string")
    return F.struct(
        (d if noul is None else noul.cast("double")).alias("noul"),
        (s if choice is None else choice).alias("choice"),
        (d if score is None else score.cast("double")).alias("score"),
        (d if confidence is None else confidence.cast("double")).alias("confidence"),
        (F.lit(None).cast("map<string,double>") if probabilities is None else probabilities).alias("probabilities"),
        (s if error is None else error).alias("error"),
    )


class Judge:
    def attach(self, df: DataFrame, ask: Ask, out: str) -> DataFrame:
        """``df`` with the answer struct in column ``out``."""
        raise NotImplementedError

    def attach_all(self, df: DataFrame, asks: Mapping[str, Ask]) -> DataFrame:
        for out, ask in asks.items():
            df = self.attach(df, ask, out)
        return df


class ExprJudge(Judge):
    """A judge made of expressions: one function per kind, from an ``Ask`` to an answer struct."""

    def __init__(self, noul: Callable[[Ask], Column] | None = None, choice: Callable[[Ask], Column] | None = None,
                 score: Callable[[Ask], Column] | None = None) -> None:
        self.by_kind = {"noul": noul, "choice": choice, "score": score}

    def attach(self, df: DataFrame, ask: Ask, out: str) -> DataFrame:
        rule = self.by_kind[ask.kind]
        if rule is None:
            raise ValueError(f"this judge does not answer {ask.kind} questions")
        return df.withColumn(out, rule(ask))


@dataclass(frozen=True)
class Limits:
    """What a request may hold, and what framing costs."""

    request_tokens: int = 64_000
    question_tokens: int = 32_000
    margin: float = 0.85
    questions: int = 128
    frame: int = 262
    per_question: int = 7

    @property
    def room(self) -> int:
        return int(self.request_tokens * self.margin)

    @property
    def lone_room(self) -> int:
        return int(self.question_tokens * self.margin)


def pack(states: list[str], state_tokens: list[int], tokens: list[int], limits: Limits) -> list[list[int]]:
    """Indices of the questions of each request, in order: a request ends when the state changes, when it is full of
    questions, or when the next one would not fit; a question that fits no request stands alone."""
    out: list[list[int]] = []
    body, last = 0, None
    for i, (s, st, t) in enumerate(zip(states, state_tokens, tokens)):
        cost = t + limits.per_question
        alone = limits.frame + st + cost > limits.lone_room
        if alone:
            out.append([i])
            last = None
            continue
        if last is None or s != last or len(out[-1]) >= limits.questions or body + cost > limits.room:
            out.append([])
            body, last = limits.frame + st, s
        out[-1].append(i)
        body += cost
    return out


class Overlimit(Exception):
    """A request was refused as too large; its questions may be asked in halves."""


class Refused(RuntimeError):
    """The service will not answer at all: a wrong key, say.  Asking again is useless, so the whole run ends."""


Handler = Callable[[dict], list[dict]]


def _asking(handler: Handler) -> Callable[[str, list[dict]], list[dict]]:
    """``(state, questions)`` to answers: in halves where refused as too large, errors as answers, refusals raised."""

    def ask_all(state: str, questions: list[dict]) -> list[dict]:
        try:
            answers = handler({"state": json.loads(state), "questions": questions})
            if len(answers) != len(questions):
                raise ValueError("the number of answers is not the number of questions")
            return answers
        except Overlimit as e:
            if len(questions) == 1:
                return [{"error": f"too large: {e}"}]
            half = len(questions) // 2
            return ask_all(state, questions[:half]) + ask_all(state, questions[half:])
        except Refused:
            raise
        except Exception as e:  # noqa: BLE001
            return [{"error": f"{type(e).__name__}: {e}"}] * len(questions)

    return ask_all


#: What a window is answered: for each question its key and the parts of an answer.
WINDOW_ANSWERS = "array<struct<key:string,noul:double,choice:string,confidence:double,probabilities:map<string,double>,error:string>>"
#: Windows whose answers a worker holds before it hands them on.
WINDOWS_AT_ONCE = 200


class BatchJudge(Judge):
    """Answers by a function from a request ``{state, questions: [{type, instructions, criteria}]}`` to a list of answers.

    Requests are packed across the Arrow batches of a partition.  A request refused as too large is halved until it fits; a
    single question that is too large, or any other error of the handler, fails only its own questions.
    """

    def __init__(self, handler: Handler, limits: Limits = Limits(), partitions: int | None = None) -> None:
        self.handler, self.limits, self.partitions = handler, limits, partitions

    def _run(self, handler: Handler, limits: Limits):
        ask_all = _asking(handler)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            keep: pd.DataFrame | None = None
            for batch in batches:
                rows = batch if keep is None else pd.concat([keep, batch], ignore_index=True)
                packed = pack(rows["_state"].tolist(), rows["_state_est"].tolist(), rows["_est"].tolist(), limits)
                keep = rows.iloc[packed[-1]].reset_index(drop=True)  # the last request may still grow
                yield from ask_rows(rows, packed[:-1])
            if keep is not None and len(keep):
                yield from ask_rows(keep, pack(keep["_state"].tolist(), keep["_state_est"].tolist(), keep["_est"].tolist(), limits))

        def ask_rows(rows: pd.DataFrame, packed: list[list[int]]) -> Iterator[pd.DataFrame]:
            parts, calls = [rows.iloc[idx] for idx in packed], []
            for part in parts:
                qs = [
                    {"type": k, "instructions": json.loads(i), "criteria": json.loads(c) if c else None}
                    for k, i, c in zip(part["_kind"], part["_instructions"], part["_criteria"])
                ]
                first = part.iloc[0]
                if len(part) == 1 and limits.frame + first["_state_est"] + first["_est"] + limits.per_question > limits.lone_room:
                    calls.append(lambda: [{"error": "too large for a request"}])
                else:
                    calls.append(lambda state=first["_state"], qs=qs: ask_all(state, qs))
            # a handler may have several requests open at once
            for part, answers in zip(parts, handler.many(calls) if hasattr(handler, "many") else (c() for c in calls)):
                yield pd.DataFrame({
                    "_row": part["_row"].to_numpy(),
                    **{n: [a.get(n) for a in answers] for n in ("noul", "choice", "score", "confidence")},
                    "probabilities": [a.get("probabilities") for a in answers],
                    "error": [a.get("error") for a in answers],
                })

        return run

    def answering(self) -> Callable[[], Callable[[list[tuple]], list[list[dict]]]]:
        """What a worker makes itself a function of: from windows ``(state, questions, state_est, ests)`` to the answers of each
        (``WINDOW_ANSWERS``), by one request for each or as many as its questions need; a handler may have several open at once."""
        handler, limits = self.handler, self.limits

        def make():
            ask_all = _asking(handler)

            def answered(windows: list[tuple]) -> list[list[dict]]:
                calls, asked, out = [], [], []
                for state, questions, state_est, ests in windows:
                    qs = [{"type": q["type"], "instructions": json.loads(q["instructions"]), "criteria": json.loads(q["criteria"]) if q["criteria"] else None} for q in questions]
                    mine = [None] * len(qs)
                    out.append(mine)
                    for idx in pack([state] * len(qs), [state_est] * len(qs), ests, limits):
                        # a question that does not fit beside its document stands alone and is not sent
                        lost = len(idx) == 1 and limits.frame + state_est + ests[idx[0]] + limits.per_question > limits.lone_room
                        calls.append((lambda: [{"error": "too large for a request"}]) if lost else (lambda state=state, some=[qs[i] for i in idx]: ask_all(state, some)))
                        asked.append((mine, questions, idx))
                for (mine, questions, idx), answers in zip(asked, handler.many(calls) if hasattr(handler, "many") else (c() for c in calls)):
                    for i, a in zip(idx, answers):
                        probs = a.get("probabilities")
                        mine[i] = {"key": questions[i]["key"], **{n: a.get(n) for n in ("noul", "choice", "confidence", "error")}, "probabilities": None if probs is None else list(probs.items())}
                return out

            return answered

        return make

    def attach_windows(self, windows: DataFrame) -> DataFrame:
        """``windows`` with ``answers`` (``WINDOW_ANSWERS``) to their ``questions(key, type, instructions, criteria)`` about their
        ``state``: a request for each window, or as many as its questions need.

        The answers are put beside the row that was asked and written once.  They are not joined back: a table of many like
        answers takes few bytes on disk, so a join would send it whole through the driver."""
        kind, answering = _parse_datatype_string(WINDOW_ANSWERS), self.answering()
        kept = [f for f in windows.schema.fields if f.name not in ("state", "questions")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            answered, arrow = answering(), to_arrow_type(kind)
            for batch in batches:
                beside = batch.select([f.name for f in kept])
                for lo in range(0, batch.num_rows, WINDOWS_AT_ONCE):
                    part = batch.slice(lo, WINDOWS_AT_ONCE)
                    got = answered(list(zip(*[part.column(c).to_pylist() for c in ("state", "questions", "_state_est", "_ests")])))
                    yield beside.slice(lo, WINDOWS_AT_ONCE).append_column("answers", pa.array(got, arrow))

        sized = windows.select("*", estimate_json(F.col("state")).alias("_state_est"),
                               F.transform("questions", lambda q: estimate_json(F.concat(q["instructions"], F.coalesce(q["criteria"], F.lit(""))))).alias("_ests"))
        if self.partitions:
            sized = sized.repartition(self.partitions)
        return durable(sized.mapInArrow(run, StructType([*kept, StructField("answers", kind)])))

    def attach(self, df: DataFrame, ask: Ask, out: str) -> DataFrame:
        """The rows are numbered and written once, so that answers come back to the right row whatever is run again."""
        rows = durable(df.withColumn("_row", F.monotonically_increasing_id()))
        q = rows.select(
            "_row", F.lit(ask.state()).alias("_state"), F.lit(ask.kind).alias("_kind"),
            ask.instructions().alias("_instructions"), F.lit(ask.criteria()).cast("string").alias("_criteria"),
        )
        criteria = F.coalesce(F.col("_criteria"), F.lit(""))
        q = q.withColumn("_est", estimate_json(F.concat("_instructions", criteria))).withColumn("_state_est", estimate_json(F.col("_state")))
        if self.partitions:
            q = q.repartition(self.partitions)
        answers = q.mapInPandas(
            self._run(self.handler, self.limits),
            "_row bigint, noul double, choice string, score double, confidence double, probabilities map<string,double>, error string",
        )
        answers = durable(answers).select("_row", F.struct("noul", "choice", "score", "confidence", "probabilities", "error").alias(out))
        return rows.join(answers, "_row").drop("_row")


def cleaned(df: DataFrame, col: str = "text") -> Column:
    """What a judge sees of a text column."""
    return clean(F.col(col))
