"""Judges over HTTP: a handler with retries and a rate, and a judge that asks in waves under a budget."""

from __future__ import annotations

import hashlib
import json
import random
import threading
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semframe.functions.text import estimate_json, estimate_py
from semframe.operators.sequence import with_position
from semframe.plans.judge import ANSWER, Ask, BatchJudge, Judge, Overlimit, Refused, answer
from semframe.session import durable

_LOCK = threading.Lock()  # of a worker's threads


@dataclass
class HttpHandler:
    """A request as one POST: ``{state, model, questions: {q0: …}}`` for ``{answers: {q0: …}, usage}``.

    Retries 429, 5xx and connection errors with growing, jittered pauses, or as long as the service says; too large a request
    (400, 413, 422) raises ``Overlimit``, so that it is asked in halves; 401 and 403 raise ``Refused``.  ``per_minute`` is this
    worker's share of a rate, ``tokens_per_minute`` its share of a rate of tokens; of both, ``burst`` minutes may be used at once.
    Up to ``most_open`` requests are open at the same time on a worker: it starts with one, a round without refusals opens one
    more, a 429 or 5xx halves them.  Equal requests are answered from a cache of the worker, so a task that is run again
    does not pay again on the same worker.
    """

    url: str
    model: str = ""
    key: str | None = None
    retries: int = 6
    first_pause: float = 0.5
    longest_pause: float = 20.0
    timeout: float = 60.0
    per_minute: float | None = None
    tokens_per_minute: float | None = None
    burst: float = 1 / 60
    most_open: int = 8
    cache: dict = field(default_factory=dict, repr=False)
    buckets: dict = field(default_factory=dict, repr=False)
    open: float = field(default=1.0, repr=False)

    def __call__(self, request: dict) -> list[dict]:
        body = json.dumps({"state": request["state"], "model": self.model, "questions": {f"q{i}": q for i, q in enumerate(request["questions"])}}, ensure_ascii=False).encode()
        name = hashlib.sha256(body).hexdigest()
        if name not in self.cache:
            if len(self.cache) > 10_000:
                self.cache.clear()
            self.cache[name] = self._ask(body)
        answers = self.cache[name]["answers"]
        return [answers[f"q{i}"] for i in range(len(request["questions"]))]

    def many(self, calls: list[Callable[[], list[dict]]]) -> Iterator[list[dict]]:
        """The results of the calls in order, in rounds of as many as may be open."""
        with ThreadPoolExecutor(self.most_open) as pool:
            at = 0
            while at < len(calls):
                k = max(1, int(self.open))
                before = self.open
                yield from pool.map(lambda c: c(), calls[at : at + k])
                at += k
                if self.open == before:  # nothing was refused
                    self.open = min(float(self.most_open), self.open + 1)

    def _take(self, name: str, rate: float | None, amount: float) -> None:
        """Wait until a bucket that fills at ``rate`` a minute, up to ``burst`` minutes, holds ``amount`` (or is full)."""
        if not rate:
            return
        while True:
            with _LOCK:
                full, now = max(rate * self.burst, 1.0), time.time()
                level, then = self.buckets.get(name, (full, now))
                level = min(full, level + (now - then) * rate / 60)
                if level >= min(amount, full):
                    self.buckets[name] = (level - amount, now)  # below zero: paid back before the next
                    return
                self.buckets[name] = (level, now)
                short = (min(amount, full) - level) * 60 / rate
            time.sleep(short)

    def _refused(self) -> None:
        with _LOCK:
            self.open = max(1.0, self.open / 2)

    def _ask(self, body: bytes) -> dict:
        pause = self.first_pause
        for k in range(self.retries + 1):
            self._take("requests", self.per_minute, 1)
            self._take("tokens", self.tokens_per_minute, estimate_py(body.decode()) if self.tokens_per_minute else 0)
            head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
            try:
                with urllib.request.urlopen(urllib.request.Request(self.url, body, head), timeout=self.timeout) as r:
                    return json.load(r)
            except urllib.error.HTTPError as e:
                if e.code in (400, 413, 422):
                    raise Overlimit(str(e.code)) from None
                if e.code in (401, 403):
                    raise Refused(str(e.code)) from None
                if e.code != 429 and e.code < 500:
                    raise
                self._refused()
                if k == self.retries:
                    raise
                said = e.headers.get("Retry-After", "")
                rest = min(60.0, float(said)) if said.replace(".", "", 1).isdigit() else pause
            except (urllib.error.URLError, TimeoutError, ConnectionError):
                if k == self.retries:
                    raise
                rest = pause
            time.sleep(rest * random.uniform(0.75, 1.25))
            pause = min(2 * pause, self.longest_pause)
        raise AssertionError


@dataclass
class WaveJudge(Judge):
    """Asks in waves of rows, in order, from the driver: after each wave the spend is known.

    ``max_tokens`` ends the asking before a wave that would go over it, and ``max_cost`` alike with a ``price`` per million
    tokens: what is left has the error ``budget``.  ``on_fail``: ``skip`` keeps failed questions as they are, ``retry`` asks them
    once more, ``stop`` raises.  Each wave is written once; no question is asked twice however often the result is read.
    """

    inner: BatchJudge
    rows_per_wave: int = 100_000
    max_tokens: int | None = None
    max_cost: float | None = None
    price: float | None = None
    on_fail: str = "skip"
    spent_tokens: int = 0
    waves: int = 0

    def _limit(self) -> int | None:
        if self.max_cost is None:
            return self.max_tokens
        if self.price is None:
            raise ValueError("a budget in money needs a price")
        most = int(self.max_cost / self.price * 1e6)
        return most if self.max_tokens is None else min(self.max_tokens, most)

    def _waves(self, df: DataFrame, ask: Ask) -> tuple[DataFrame, list]:
        """The rows by wave, and the tokens of each wave (one row per wave)."""
        rows = with_position(df, [], "_wave_pos")
        rows = durable(rows.withColumn("_wave", F.floor(F.col("_wave_pos") / self.rows_per_wave)))
        est = estimate_json(ask.instructions()) + self.inner.limits.per_question
        return rows, rows.groupBy("_wave").agg(F.sum(est).alias("t")).orderBy("_wave").collect()

    def _asked(self, rows: DataFrame, ask: Ask, out: str) -> DataFrame:
        wave = durable(self.inner.attach(rows, ask, out))
        bad = wave.where(F.col(f"{out}.error").isNotNull())
        if self.on_fail == "skip" or bad.isEmpty():
            return wave
        if self.on_fail == "stop":
            raise RuntimeError(bad.select(f"{out}.error").first()[0])
        return durable(wave.where(F.col(f"{out}.error").isNull()).unionByName(self.inner.attach(bad.drop(out), ask, out)))

    def attach(self, df: DataFrame, ask: Ask, out: str) -> DataFrame:
        """``df`` with answers: as many rows as there were, however often the judge was used before; the budget is that of
        all uses together, the waves are those of this use."""
        return self.attach_until(df, ask, out)

    def attach_until(self, df: DataFrame, ask: Ask, out: str, enough: Column | None = None, n: int = 0) -> DataFrame:
        """As ``attach``, but once ``n`` rows fulfil ``enough`` no further wave is asked: what is left has the error ``stopped``.
        Waves follow the order of ``df``, so the first ``n`` are among the rows asked."""
        limit, (rows, sizes) = self._limit(), self._waves(df, ask)
        parts, asked, why, hits = [], 0, "budget", 0
        for r in sizes:
            if enough is not None and hits >= n:
                why = "stopped"
                break
            if limit is not None and self.spent_tokens + r["t"] > limit:
                break
            wave = self._asked(rows.where(F.col("_wave") == r["_wave"]), ask, out)
            self.spent_tokens += r["t"]
            self.waves += 1
            asked += 1
            parts.append(wave)
            if enough is not None:
                hits += wave.where(enough).count()
        if asked < len(sizes) or not parts:
            kind = parts[0].schema[out].dataType if parts else ANSWER
            parts.append(rows.where(F.col("_wave") >= asked).withColumn(out, answer(error=F.lit(why)).cast(kind)))
        # in pairs: a plan as deep as the logarithm of the waves
        while len(parts) > 1:
            parts = [parts[i].unionByName(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0].drop("_wave_pos", "_wave")


def usage(judged: DataFrame, out: str = "error") -> DataFrame:
    """One row: questions answered, failed, and left out for the budget or because there was enough."""
    e = F.col(out)
    unasked = e.isin("budget", "stopped")
    return judged.agg(F.count_if(e.isNull()).alias("answered"), F.count_if(e.isNotNull() & ~unasked).alias("failed"), F.count_if(unasked).alias("left"))
