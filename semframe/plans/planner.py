"""What a run will cost before it is made: quotes, prices, billing rules, gates."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from semframe.functions.text import estimate_json
from semframe.operators.sequence import with_position
from semframe.plans.judge import Ask, Limits
from semframe.session import durable


@dataclass(frozen=True)
class Quote:
    """Questions, requests and tokens of a run, and its cost in USD where the price is known."""

    questions: int = 0
    requests: int = 0
    tokens: int = 0
    usd: float | None = None

    def __add__(self, other: "Quote") -> "Quote":
        usd = None if self.usd is None or other.usd is None else self.usd + other.usd
        return Quote(self.questions + other.questions, self.requests + other.requests, self.tokens + other.tokens, usd)


class Billing:
    """The state of a request is paid for once."""

    def base(self, state: int, limits: Limits) -> int:
        return limits.frame + state

    def per(self, state: int, tokens: int, kind: str, size: int, limits: Limits) -> int:
        return tokens + limits.per_question


class PerQuestion(Billing):
    """Each question is a pass over the state: passes cost a ratio of the estimate plus framing, options of a choice a little
    more, scores of three or more levels several passes and a thought per level.  Fixed values as published."""

    ratio, frame, option, think, level = 0.8, 47, 8, 3, 120

    def base(self, state: int, limits: Limits) -> int:
        return 0

    def per(self, state: int, tokens: int, kind: str, size: int, limits: Limits) -> int:
        one = int(self.ratio * (state + tokens) + 0.5) + self.frame
        if kind == "score" and size >= 3:
            return self.think * one + self.level * size
        return one + self.option * size if kind == "choice" else one


def price_of(model: str, prices: Mapping[str, float]) -> float | None:
    """USD per million input tokens by the longest prefix of the model's name, in any case; a gateway's prefix is dropped."""
    for name in (model, model.rpartition("/")[2]):
        hits = [k for k in prices if name.lower().startswith(k.lower())]
        if hits:
            return prices[max(hits, key=len)]
    return None


def cost_of(tokens: int, price: float | None) -> float | None:
    return None if price is None else tokens * price / 1e6


def plan(df: DataFrame, ask: Ask, *, limits: Limits = Limits(), billing: Billing | None = None, price: float | None = None, exact: bool = False) -> Quote:
    """The quote of one question per row, without asking any.

    Tokens are summed in the JVM.  Requests are counted from the sums (questions of one state fill requests); ``exact`` packs them
    in order as a run would, by blocks.
    """
    billing = billing or Billing()
    size = len(ask.options) or len(ask.levels)
    criteria = ask.criteria() or ""
    state = estimate_json(F.lit(ask.state()))
    est = df.select(estimate_json(F.concat(ask.instructions(), F.lit(criteria))).alias("est"), state.alias("state"))
    if exact:
        rows = est.withColumn("_g", F.lit(0)).withColumn("_i", F.monotonically_increasing_id())
        packed = packed_requests(durable(rows), state="_g", state_est="state", est="est", group=["_g"], by=["_i"], limits=limits)
        r = packed.agg(F.count(F.lit(1)).alias("n"), F.max("request").alias("last"), F.max("state").alias("state"), F.sum("est").alias("est")).collect()[0]
        if not r["n"]:
            return Quote(usd=cost_of(0, price))
        requests = r["last"] + 1
        if type(billing) is Billing:
            body = r["est"] + r["n"] * limits.per_question
        else:  # what a question costs may depend on it: sizes are few
            sizes = est.groupBy("est").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per size, at most as many as a question has tokens
            body = sum(x["n"] * billing.per(r["state"], x["est"], ask.kind, size, limits) for x in sizes)
        tokens = requests * billing.base(r["state"], limits) + body
        return Quote(r["n"], requests, tokens, cost_of(tokens, price))
    r = est.agg(F.count(F.lit(1)).alias("n"), F.sum("est").alias("est"), F.max("state").alias("state")).collect()[0]
    if not r["n"]:
        return Quote(usd=cost_of(0, price))
    body = r["est"] + r["n"] * limits.per_question
    requests = max(-(-r["n"] // limits.questions), -(-body // max(1, limits.room - limits.frame - r["state"])))
    mean = r["est"] / r["n"]
    tokens = requests * billing.base(r["state"], limits) + int(r["n"] * billing.per(r["state"], mean, ask.kind, size, limits))
    return Quote(r["n"], requests, tokens, cost_of(tokens, price))


def bisect_bound(n: int, k: int, state: int, per_question: int, verify: bool = False) -> Quote:
    """At most what a k-ary search over ``n`` records asks."""
    rounds, span = 1, float(n)
    while span > k:
        span /= k + 1
        rounds += 1
    questions = min(n, rounds * k + 2)
    if verify:
        rounds, questions = rounds + 1, questions + 2
    return Quote(questions, rounds, rounds * state + questions * per_question)


def sort_bound(n: int, passes: int, seed: Quote, tokens_per_pass: int) -> Quote:
    """The seed and every pass a sort may make: two questions per pair, pairs on alternating halves."""
    return seed + Quote(passes * max(0, n - 1), passes, passes * tokens_per_pass, seed.usd) if passes and n > 1 else seed


def pick_bound(windows: int, candidates: int, tokens: int, keep: int, size: int, per_request: int) -> Quote:
    """What a tournament asks: a choice and an existence question for each of the first ``windows``, whose records have ``tokens``
    tokens together, and a choice for each window of the rounds after, among ``keep`` finalists of each."""
    requests, questions, total, now = windows, 2 * windows, tokens + windows * per_request, windows
    mean = tokens / candidates if candidates else 0.0
    while now > 1:
        finalists = min(now * keep, candidates)
        now = -(-finalists // max(size, 2 * keep))
        requests, questions, total = requests + now, questions + now, total + int(finalists * mean) + now * per_request
    return Quote(questions, requests, total)


def tree_bound(records: int, levels: list[int], beam: int, per_question: int) -> Quote:
    """At most what labels by a taxonomy ask: per record and level one choice for each open path; ``levels`` are the numbers of
    parents with a choice on each level."""
    questions = records * sum(min(beam, n) for n in levels)
    return Quote(questions, questions, questions * per_question)


def walk_bound(rounds: int, beam: int, per_question: int, verified: int = 0) -> Quote:
    """At most what a walk of so many rounds asks: a choice for each of the ``beam`` open places, and the verification."""
    questions = 1 + max(0, rounds - 1) * beam + verified
    return Quote(questions, questions, questions * per_question)


def projection(spent: int, asked: int, total: int) -> int:
    """What a run will have spent when all is asked, from what it has spent so far."""
    return spent if asked <= 0 else round(spent * max(total, asked) / asked)


class BudgetExceeded(RuntimeError):
    """A quote is over a limit; nothing was asked."""


def confirm(quote: Quote, *, max_cost: float | None = None, daily_left: float | None = None, monthly_left: float | None = None,
            confirm_above: float | None = None, agreed: bool = False) -> None:
    """The gate before a run: its own budget, then the caps, then consent above an amount.  A cap needs a known price; an
    explicit ``max_cost`` that covers the quote is consent."""
    capped = [x for x in (max_cost, daily_left, monthly_left) if x is not None]
    if capped and quote.usd is None:
        raise BudgetExceeded("there is a cap, but the price is not known")
    for name, left in (("the budget of the run", max_cost), ("the daily cap", daily_left), ("the monthly cap", monthly_left)):
        if left is not None and quote.usd > left:
            raise BudgetExceeded(f"the quote of ${quote.usd:.4f} is over {name}, ${left:.4f}")
    if confirm_above is not None and (quote.usd or 0) > confirm_above and not agreed and max_cost is None:
        raise BudgetExceeded(f"the quote of ${quote.usd:.4f} needs consent")


#: Questions whose requests one task finds at a time.
BLOCK = 1 << 14


def _ends(cost: np.ndarray, room: np.ndarray, own: np.ndarray, new: np.ndarray, limits: Limits) -> np.ndarray:
    """For each question where the request ends that starts with it, as ``judge.pack`` would end it."""
    n = len(cost)
    at, sums = np.arange(n), np.concatenate(([0], np.cumsum(cost)))
    fits = np.searchsorted(sums, sums[:-1] + room, side="right") - 1
    stop = np.minimum.accumulate(np.where(own | new, at, n)[::-1])[::-1]
    end = np.minimum(np.minimum(np.maximum(fits, at + 1), at + limits.questions), np.append(stop[1:], n))
    return np.where(own, at + 1, end)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one block at a time, from a partition sorted by block."""
    kept: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        block = rows.column("_block").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for a, z in zip(cuts, cuts[1:]):
            if kept and kept[-1].column("_block")[0].as_py() != block[a]:
                yield pa.concat_tables(kept)
                kept = []
            kept.append(rows.slice(a, z - a))
    if kept:
        yield pa.concat_tables(kept)


def _parts(rows: pa.Table) -> list[np.ndarray]:
    return [rows.column(c).to_numpy() for c in ("_cost", "_room", "_own", "_new")]


def packed_requests(df: DataFrame, *, state: str = "state", state_est: str = "state_est", est: str = "est", group: list[str], by: list[str], limits: Limits = Limits(), block: int = BLOCK) -> DataFrame:
    """``request`` for each question, from 0 in each group (a state): the requests of ``judge.pack`` over the questions in order.
    A question of unknown size has a request of its own.

    A request ends at most ``limits.questions`` after its start.  So a block of questions, with as many of the next one, tells for
    each start it may be entered at where the next block is entered and how many requests lie between; one pass over these in
    order gives the start of each block, and then each block is packed by itself, however large its state is.
    """
    block, columns = max(block, limits.questions), df.columns
    placed = with_position(df, [*group, *by], "_pos")
    first = placed.groupBy(*group).agg(F.min("_pos").alias("_first"))
    same = [F.col(f"p.{g}").eqNullSafe(F.col(f"f.{g}")) for g in group]
    need = F.lit(limits.frame) + F.col(state_est).cast("long") + F.col(est) + limits.per_question
    rows = placed.alias("p").join(first.alias("f"), same).select(
        "p.*", F.floor(F.col("_pos") / block).alias("_block"), (F.col("_pos") == F.col("_first")).alias("_new"),
    ).withColumn("_own", F.coalesce(need > limits.lone_room, F.lit(True)))
    rows = rows.withColumn("_cost", F.when(F.col("_own"), 0).otherwise(F.col(est) + limits.per_question).cast("long"))
    rows = rows.withColumn("_room", F.coalesce(F.lit(limits.room - limits.frame) - F.col(state_est), F.lit(0)).cast("long"))

    def jumps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            at = rows.column("_block")[0].as_py()
            n = int(np.count_nonzero(rows.column("_pos").to_numpy() < (at + 1) * block))
            parts = _parts(rows)
            end, new = _ends(*parts, limits).tolist(), parts[3].tolist()
            leaves, count, restarts = [0] * n, [1] * n, new[:n]  # requests are counted from the last new group on
            for i in range(n - 1, -1, -1):
                if (j := end[i]) >= n:
                    leaves[i] = j - n
                else:
                    leaves[i], count[i], restarts[i] = leaves[j], count[j] + (not restarts[j]), restarts[j] or new[i]
            k = limits.questions
            yield pa.RecordBatch.from_pydict({"_block": [at], "leaves": [leaves[:k]], "count": [count[:k]], "restarts": [restarts[:k]]})

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, before = 0, 0
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                out.append({"_block": r["_block"], "_start": start, "_before": before})
                if start < len(r["leaves"]):  # else the last block ends within a request
                    before = r["count"][start] + (0 if r["restarts"][start] else before)
                    start = r["leaves"][start]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([(c, pa.int64()) for c in ("_block", "_start", "_before")]))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            parts, n = _parts(rows), rows.num_rows
            end, new = _ends(*parts, limits).tolist(), parts[3].tolist()
            i, k = rows.column("_start")[0].as_py(), rows.column("_before")[0].as_py()
            request = np.full(n, k - 1, dtype=np.int64)
            while i < n:
                k = 0 if new[i] else k
                request[i : end[i]] = k
                i, k = end[i], k + 1
            yield from rows.select(columns).append_column("request", pa.array(request)).to_batches()

    near = F.when((F.col("_pos") % block < limits.questions) & (F.col("_block") > 0), F.array("_block", F.col("_block") - 1)).otherwise(F.array("_block"))
    around = rows.select(F.explode(near).alias("_block"), "_pos", "_cost", "_room", "_own", "_new")
    seen = around.repartition("_block").sortWithinPartitions("_block", "_pos").mapInArrow(jumps, "_block long, leaves array<long>, count array<long>, restarts array<boolean>")
    starts = seen.repartition(1).sortWithinPartitions("_block").mapInArrow(enter, "_block long, _start long, _before long")
    there = rows.join(F.broadcast(starts), "_block").repartition("_block").sortWithinPartitions("_block", "_pos")
    return there.mapInArrow(packed, StructType([*df.schema.fields, StructField("request", LongType())]))
