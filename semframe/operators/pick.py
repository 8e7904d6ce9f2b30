"""The best-answering records of an input by a tournament over windows, or the best regex match."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from semframe.functions.text import clean, cleaned_estimates, estimate, tagged_id
from semframe.operators.sequence import BLOCK
from semframe.operators.test import NO, UNCERTAIN, YES
from semframe.operators.windows import asking_choices, choose_in_windows, question as ask_question, state_of, windowed
from semframe.plans.judge import Ask, BatchJudge, ExprJudge, Judge
from semframe.session import durable

# A window's candidates and estimated tokens, and the finalists it sends on.
WINDOW, WINDOW_TOKENS, FINALISTS = 255, 16_000, 3
MAX_SPANS, LONG_SPAN, WHOLE_TOKENS = 254, 100, 20_000
#: Parts of a group in which its best are looked for first.
PARTS = 32
#: Windows of a group that a task asks about at once.
AT_ONCE = 32
#: ``(?U)\\S`` of Java.
_SHOWN = re.compile(r"[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def wording(question: str) -> str:
    """A question is answered, anything else described."""
    q = question.strip()
    return f"How well does `text` answer: {q}" if q.endswith("?") else f"How well does this describe `text`: {q}"


def existence(question: str) -> str:
    """Whether there is an answer at all."""
    q = question.strip()
    return f"Does any line of `document` answer: {q}" if q.endswith("?") else f"Does any line of `document` fit this description: {q}"


def choice_wording(question: str) -> str:
    q = question.strip()
    return f"Which line of `document` best answers: {q}" if q.endswith("?") else f"Which line of `document` does this describe best: {q}"


def sem_pick(df: DataFrame, judge: Judge, question: str, *, best: int = 1, threshold: float = 0.5, min_p: float = 0.0, force: bool = False,
             group: Sequence[str] = ("file_idx",), text: str = "text", window: int = WINDOW, tokens: int = WINDOW_TOKENS,
             context: dict[str, str] | None = None) -> DataFrame:
    """The ``best`` records of each group that answer the question: ``place, num, text, p, exists, verdict``.

    Each window sends its ``max(3, best)`` best on, in record order, until one window is left.  A judge by packed requests sees
    each window as a document, makes one choice among its lines, and is asked in the first round whether there is an answer
    at all.  A judge by expression is asked about each record by itself, which gives the same without the rounds.  ``exists`` is the largest probability of the first round: below ``threshold`` the verdict is *no* and, unless ``force``, there are no rows.  A last
    probability under ``min_p`` is *uncertain*.  Blank and null records are no candidates; ties go to the earlier record.
    """
    cands = df.where(F.col(text).rlike("(?U)\\S")).select(*group, "num", F.col(text).alias("text"), clean(F.col(text)).alias("_text"))
    if isinstance(judge, ExprJudge):
        return _decided(*_best_by_record(cands, judge, question, best, group, context), best, group, threshold, min_p, force)
    keep = max(FINALISTS, best)
    if not isinstance(judge, BatchJudge):
        return _decided(*_by_rounds(cands, judge, question, best, keep, group, window, tokens, context), best, group, threshold, min_p, force)
    # what the judge sees is made where it is shown, and so not shuffled beside the text
    cands = cands.drop("_text")
    long = durable(df.where(F.col("num") >= BLOCK).select(*group).distinct())
    if long.isEmpty():
        return _decided(_by_group(cands, judge, question, best, keep, group, window, tokens, context), None, best, group, threshold, min_p, force)
    same = [F.col(f"c.{g}").eqNullSafe(F.col(f"l.{g}")) for g in group]
    some, rest = (cands.alias("c").join(long.alias("l"), same, how) for how in ("left_semi", "left_anti"))
    by_rounds = _by_rounds(some.where(clean(F.col("text")).rlike("(?U)\\S")), judge, question, best, keep, group, window, tokens, context)
    by_group = _by_group(rest, judge, question, best, keep, group, window, tokens, context)
    return _decided(*by_rounds, best, group, threshold, min_p, force).unionByName(_decided(by_group, None, best, group, threshold, min_p, force))


def _by_rounds(cands: DataFrame, judge: Judge, question: str, best: int, keep: int, group: Sequence[str], window: int, tokens: int,
               context: dict[str, str] | None) -> tuple[DataFrame, DataFrame]:
    """The tournament with each round over all groups at once, so that no group is one task."""
    seen: Column | str = clean(F.col("text")) if isinstance(judge, BatchJudge) else "_text"
    ask = Ask("noul", wording(question), {"text": F.col("_text")}, context=context or {})
    exists, now, size = None, cands, max(window, 2 * keep)
    while True:
        # later rounds go by number alone: long records, few to a window, would else never become fewer
        placed = windowed(now, group, size, tokens if exists is None else None, seen)
        if isinstance(judge, BatchJudge):
            asked = choose_in_windows(placed, judge, choice_wording(question), existence(question) if exists is None else None, group, context, seen)
        else:
            one = judge.attach(placed, ask, "_answer")
            asked = one.withColumn("p", F.col("_answer.noul")).withColumn("exists", F.col("p")).drop("_answer")
        judged = durable(asked.withColumn("p", F.coalesce("p", F.lit(-1.0))))
        if exists is None:
            exists = judged.groupBy(*group).agg(F.max(F.coalesce("exists", F.lit(-1.0))).alias("exists"))
        judged = judged.drop("exists")
        rank = F.row_number().over(Window.partitionBy(*group, "window").orderBy(F.col("p").desc(), "num"))
        last = judged.groupBy(*group).agg(F.countDistinct("window").alias("w")).where("w > 1").isEmpty()
        if last:
            break
        now = judged.withColumn("_r", rank).where(F.col("_r") <= keep).drop("_r", "window", "p")
    final = judged.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(F.col("p").desc(), "num"))).where((F.col("place") <= best) & (F.col("p") >= 0))
    return final, exists


class _Tournament:
    """The tournament of one group whose candidates come in order: ``add`` each, then ``ended``.  It holds ``AT_ONCE`` windows and
    the finalists of those before, whatever the length of the group."""

    def __init__(self, ask, keep: int, size: int, tokens: int) -> None:
        self.ask, self.keep, self.size, self.tokens = ask, keep, size, tokens
        self.window: list[tuple] = []
        self.full: list[list[tuple]] = []
        self.body, self.exists = 0, -1.0
        self.finalists: list[list[tuple]] = []

    def add(self, num, raw: bytes, seen: str, est: int) -> None:
        alone = est > self.tokens
        if self.window and (alone or len(self.window) >= self.size or self.body + est > self.tokens):
            self.close()
        self.window.append((num, raw, seen))
        self.body += est
        if alone:
            self.close()

    def close(self) -> None:
        self.full.append(self.window)
        self.window, self.body = [], 0
        if len(self.full) >= AT_ONCE:
            self.first_round()

    def first_round(self) -> None:
        self.finalists += self.asked(self.full, True)
        self.full = []

    def asked(self, windows: list[list[tuple]], first: bool) -> list[list[tuple]]:
        """``(p, (num, raw, seen))`` of the best of each window that the records were shown in, the best first."""
        out = []
        for records, parts in zip(windows, self.ask([[r[2] for r in w] for w in windows], first)):
            at = 0
            for ps, exists in parts:
                self.exists = max(self.exists, -1.0 if exists is None else float(exists), key=_above)
                out.append(self.best_of([(-1.0 if p is None else p, r) for p, r in zip(ps, records[at:])]))
                at += len(ps)
        return out

    def best_of(self, judged: list[tuple]) -> list[tuple]:
        judged = sorted(judged, key=lambda x: x[1][0])
        return sorted(judged, key=lambda x: _above(x[0]), reverse=True)[: self.keep]  # stable: ties go to the earlier record

    def ended(self) -> list[tuple]:
        if self.window:
            self.close()
        if self.full:
            self.first_round()
        while len(self.finalists) > 1:
            now = sorted((r for w in self.finalists for _, r in w), key=lambda r: r[0])
            self.finalists = self.asked([now[lo : lo + self.size] for lo in range(0, len(now), self.size)], False)
            if len(self.finalists) > 1 and sum(map(len, self.finalists)) == len(now):  # refused as too large down to windows that all go on
                self.finalists = [self.best_of([x for w in self.finalists for x in w])]
        return self.finalists[0] if self.finalists else []


def _above(p: float) -> tuple[bool, float]:
    """Order of numbers as in Spark: above all is what is none."""
    return (p != p, 0.0 if p != p else p)


def _by_group(cands: DataFrame, judge: BatchJudge, question: str, best: int, keep: int, group: Sequence[str], window: int, tokens: int,
              context: dict[str, str] | None) -> DataFrame:
    """The best of each group with ``exists``: the text is shuffled once, and only these rows are written.  For groups that one
    task can go through; a group is asked about until it has one window left, whatever others need."""
    making, size = asking_choices(judge, choice_wording(question), existence(question), context), max(window, 2 * keep)
    fields = {f.name: f for f in cands.schema.fields}
    rows = cands.withColumn("text", F.col("text").cast("binary"))  # bytes come back as they were
    kind = StructType([*(fields[g] for g in group), StructField("place", IntegerType()), rows.schema["num"], rows.schema["text"], StructField("p", DoubleType()), StructField("exists", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask, schema = making(), to_arrow_schema(kind)
        key, now, out = None, None, []

        def finish() -> None:
            for place, (p, (num, raw, _)) in enumerate(now.ended()[:best], 1):
                if not p < 0:
                    out.append((*key, place, num, raw, p, now.exists))

        def drained() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out.clear()
            return got

        for batch in batches:
            keys = zip(*[batch.column(g).to_pylist() for g in group])
            seen, ests = cleaned_estimates(batch.column("text"))
            for k, num, raw, text, est in zip(keys, batch.column("num").to_pylist(), batch.column("text").to_pylist(), seen, ests):
                if now is None or k != key and not all(a == b or a != a and b != b for a, b in zip(k, key)):
                    if now is not None:
                        finish()
                    key, now = k, _Tournament(ask, keep, size, tokens)
                if _SHOWN.search(text):
                    now.add(num, raw, text, est)
            if out:
                yield drained()
        if now is not None:
            finish()
        if out:
            yield drained()

    where = [judge.partitions] if judge.partitions else []
    got = durable(rows.repartition(*where, *group).sortWithinPartitions(*group, "num").mapInArrow(run, kind))
    return got.withColumn("text", F.col("text").cast("string"))


def _best_by_record(cands: DataFrame, judge: ExprJudge, question: str, best: int, group: Sequence[str], context: dict[str, str] | None) -> tuple[DataFrame, DataFrame]:
    """What the tournament ends with if each record is judged by itself: the best of each group, found in parts of a group first."""
    judged = judge.attach(cands, Ask("noul", wording(question), {"text": F.col("_text")}, context=context or {}), "_answer")
    judged = judged.select(*group, "num", "text", F.coalesce(F.col("_answer.noul"), F.lit(-1.0)).alias("p"), F.pmod(F.xxhash64("num"), F.lit(PARTS)).alias("_part"))
    order = [F.col("p").desc(), F.col("num")]
    some = judged.withColumn("_r", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order))).where(F.col("_r") <= best).drop("_r", "_part")
    final = some.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).withColumn("exists", F.max("p").over(Window.partitionBy(*group)))
    return final.where((F.col("place") <= best) & (F.col("p") >= 0)), None


def _decided(final: DataFrame, exists: DataFrame | None, best: int, group: Sequence[str], threshold: float, min_p: float, force: bool) -> DataFrame:
    out = final if exists is None else final.alias("f").join(exists.alias("e"), [F.col(f"f.{g}").eqNullSafe(F.col(f"e.{g}")) for g in group]).select("f.*", "e.exists")
    out = out.select(*group, "place", "num", "text", "p", "exists")
    v = F.when(F.col("exists") < threshold, NO).when(F.col("p") < min_p, UNCERTAIN).otherwise(YES)
    out = out.withColumn("verdict", v)
    return out if force else out.where(F.col("verdict") != NO)


def windows_of(df: DataFrame, group: Sequence[str] = ("file_idx",), text: str = "text", window: int = WINDOW, tokens: int = WINDOW_TOKENS) -> DataFrame:
    """``group, window, n``: the first round's windows, as a quote counts them."""
    cands = df.where(F.col(text).rlike("(?U)\\S")).select(*group, "num", clean(F.col(text)).alias("_text"))
    return windowed(cands, group, window, tokens).groupBy(*group, "window").agg(F.count(F.lit(1)).alias("n"))


def candidates(texts: DataFrame, patterns: Sequence[str], key: Sequence[str] = ("file_idx",), text: str = "text") -> DataFrame:
    """``key, start, span, line, around``: the distinct matches of several patterns in each whole text, each with its first place (the
    earlier pattern wins), in order of place; ``line`` is 1-based."""
    from semframe.operators.edit import match_spans

    out = None
    for i, p in enumerate(patterns):
        one = texts.select(*key, F.explode(match_spans(F.col(text), p)).alias("s")).select(
            *key, F.lit(i).alias("_pat"), "s.start", F.col("s.text").alias("span"), "s.line", F.concat("s.left", "s.text", "s.right").alias("around"))
        out = one if out is None else out.unionAll(one)
    first = out.groupBy(*key, "span").agg(F.min(F.struct("_pat", "start", "line", "around")).alias("m"))
    return first.select(*key, F.col("m.start").alias("start"), "span", F.col("m.line").alias("line"), F.col("m.around").alias("around"))


def _chosen_match(texts: DataFrame, found: DataFrame, judge: BatchJudge, question: str, threshold: float, key: Sequence[str], text: str) -> DataFrame:
    """One choice per text; a text has as many matches as a choice may hold, so they are one row."""
    many = found.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MAX_SPANS).limit(1).collect()
    if many:
        raise ValueError(f"{many[0]['n']} different matches in one text, more than {MAX_SPANS}")
    one = found.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("start", "span", "line", "around"))).alias("ms"))
    by_id = F.exists("ms", lambda m: (F.length(m["span"]) > LONG_SPAN) | m["span"].contains("\n"))
    one = one.withColumn("by_id", by_id).withColumn("names", F.transform("ms", lambda m, i: F.when(F.col("by_id"), tagged_id("M", i + 1, 3)).otherwise(m["span"])))
    # the escape is in brackets until no match is called so
    taken = lambda n: F.array_contains("names", n)
    none = F.when(~taken("none"), F.lit("none")).when(~taken("(none)"), F.lit("(none)")).otherwise(F.lit("((none))"))
    one = one.join(texts.select(*key, clean(F.col(text)).alias("_whole")), list(key))
    parts = F.array_join(F.array_distinct(F.transform("ms", lambda m: F.concat_ws(" ", F.lit("…"), clean(m["around"])))), "\n")
    one = one.withColumn("none", none).withColumn("document", F.when(estimate(F.col("_whole")) <= WHOLE_TOKENS, F.col("_whole")).otherwise(parts))
    means = F.transform("ms", lambda m: F.when(F.col("by_id"), clean(m["span"])).otherwise(""))
    criteria = F.to_json(F.map_from_arrays(F.concat("names", F.array("none")), F.concat(means, F.array(F.lit("none of them")))))
    asked = F.array(ask_question(F.lit("match"), "choice", F.lit(f"Which match in `document` answers: {question}"), criteria))
    got = judge.attach_windows(one.withColumn("state", state_of(None)).withColumn("questions", asked).drop("_whole", "document"))
    probs = F.get("answers", 0)["probabilities"]
    each = got.withColumn("_p", probs).where(F.col("_p").isNotNull()).select(*key, F.coalesce(F.try_element_at("_p", "none"), F.lit(0.0)).alias("none"), F.transform(
        "ms", lambda m, i: F.struct((-F.coalesce(F.try_element_at(F.col("_p"), F.get("names", i)), F.lit(0.0))).alias("q"), m["start"].alias("start"), m["span"].alias("span"), m["line"].alias("line"))).alias("ms"))
    best = each.withColumn("b", F.array_min("ms"))
    out = best.where(-F.col("b.q") > F.col("none")).select(*key, F.col("b.start").alias("start"), F.col("b.span").alias("span"), F.col("b.line").alias("line"), (-F.col("b.q")).alias("p"))
    return out.withColumn("verdict", F.when(F.col("p") < threshold, UNCERTAIN).otherwise(YES))


def sem_pick_match(texts: DataFrame, judge: Judge, patterns: Sequence[str], question: str, *, threshold: float = 0.5, key: Sequence[str] = ("file_idx",),
                   text: str = "text") -> DataFrame:
    """The one match of the patterns that answers the question, per text: ``key, start, span, line, p, verdict``.

    Each match is judged with the line it stands in, clipped; the best wins unless it is less likely than not (*no*, no row) or under
    ``threshold`` (*uncertain*).  Ties go to the earlier match.

    A judge by packed requests makes one choice among all distinct matches of a text, or none of them: at most ``MAX_SPANS``, more
    are an error; if one is longer than ``LONG_SPAN`` or goes over lines, all are offered by ids ``M001`` with what they stand for.
    Of a text over ``WHOLE_TOKENS`` tokens it sees the surroundings of the matches.
    """
    found = candidates(texts, patterns, key, text)
    if isinstance(judge, BatchJudge):
        return _chosen_match(texts, found, judge, question, threshold, key, text)
    ask = Ask("noul", f"Is `span` the answer to: {question}", {"text": clean(F.col("around")), "span": clean(F.col("span"))})
    judged = judge.attach(found, ask, "_answer").withColumn("p", F.col("_answer.noul"))
    best = judged.where(F.col("p").isNotNull()).groupBy(*key).agg(F.min(F.struct((-F.col("p")).alias("q"), "start", "span", "line")).alias("b"))
    out = best.select(*key, F.col("b.start").alias("start"), F.col("b.span").alias("span"), F.col("b.line").alias("line"), (-F.col("b.q")).alias("p"))
    return out.where("p >= 0.5").withColumn("verdict", F.when(F.col("p") < threshold, UNCERTAIN).otherwise(YES))
