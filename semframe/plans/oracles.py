"""Deterministic judges as Catalyst expressions: for tests, for the registered queries, and for rules of one's own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from semframe.plans.judge import Ask, ExprJudge, answer

# The probabilities of the default oracle.
YES, MAYBE, NO = 0.95, 0.5, 0.05
_MARK = r"p=([0-9]*\.?[0-9]+)"


def marked(text: Column, otherwise: Column) -> Column:
    """A ``p=0.73`` marker in the text wins over a rule."""
    found = F.regexp_extract(text, _MARK, 1)
    return F.when(found != "", found.cast("double")).otherwise(otherwise)


def default_noul(ask: Ask) -> Column:
    s = F.lower(ask.subject())
    return answer(noul=marked(s, F.when(s.contains("yes"), F.lit(YES)).when(s.contains("maybe"), F.lit(MAYBE)).otherwise(F.lit(NO))))


def _distribution(ask: Ask, won: Column, top: float = 0.9) -> Column:
    names = [o.name for o in ask.options]
    n = len(names)
    rest = (1 - top) / (n - 1) if n > 1 else 0.0
    pairs: list[Column] = []
    for x in names:
        pairs += [F.lit(x), F.when(won.isNull(), F.lit(1.0 / n)).when(won == x, F.lit(top if n > 1 else 1.0)).otherwise(F.lit(rest))]
    return F.create_map(*pairs)


def first_named(text: Column, names: Sequence[str]) -> Column:
    """The first option whose name occurs in the (lower) text; null for none."""
    won = F.lit(None).cast("string")
    for x in reversed(names):
        won = F.when(text.contains(x.lower()), F.lit(x)).otherwise(won)
    return won


def default_choice(ask: Ask) -> Column:
    won = first_named(F.lower(ask.subject()), [o.name for o in ask.options])
    return answer(
        choice=F.coalesce(won, F.lit(ask.options[0].name)),
        confidence=F.when(won.isNull(), 0.0).otherwise(0.8),
        probabilities=_distribution(ask, won),
    )


def default_score(ask: Ask) -> Column:
    n = len(ask.levels)
    said = F.regexp_extract(F.lower(ask.subject()), r"level=(\d{1,3})", 1).try_cast("int")
    score = F.when(said.between(0, n - 1), said.cast("double")).otherwise(F.lit((n - 1) / 2))
    pairs: list[Column] = []
    for k in range(n):
        pairs += [F.lit(str(k)), F.when(F.round(score) == k, 1.0).otherwise(0.0)]
    return answer(score=score, confidence=F.lit(1.0), probabilities=F.create_map(*pairs))


def default_oracle() -> ExprJudge:
    """Yes where the text says yes; the first option named; the level given."""
    return ExprJudge(default_noul, default_choice, default_score)


def keyword_oracle(escape: str | None = None, unsure: str = "unsure") -> ExprJudge:
    """Choices by keyword, falling back to the last option; a text that says it is unsure has confidence 0.3."""

    def choice(ask: Ask) -> Column:
        s = F.lower(ask.subject())
        won = F.coalesce(first_named(s, [o.name for o in ask.options]), F.lit(ask.options[-1].name if escape is None else escape))
        return answer(choice=won, confidence=F.when(s.contains(unsure), 0.3).otherwise(0.8), probabilities=_distribution(ask, won))

    return ExprJudge(default_noul, choice, default_score)


def rule_oracle(rules: Sequence[tuple[str, float]], otherwise: float = NO) -> ExprJudge:
    """Yes/no by the first word that occurs, each with its probability."""

    def noul(ask: Ask) -> Column:
        s = F.lower(ask.subject())
        p = F.lit(float(otherwise))
        for word, x in reversed(rules):
            p = F.when(s.contains(word.lower()), F.lit(float(x))).otherwise(p)
        return answer(noul=p)

    return ExprJudge(noul, default_choice, default_score)


def column_oracle(p: Column) -> ExprJudge:
    """Yes/no by an expression over the columns of the frame."""
    return ExprJudge(lambda ask: answer(noul=p), default_choice, default_score)


def _fields_of(text: Column) -> Column:
    return F.split(F.regexp_replace(F.lower(text), "^\\s+|\\s+\\z", ""), "\\s+")


def same_first_word() -> ExprJudge:
    """Two records mean the same if their first words are equal."""

    def noul(ask: Ask) -> Column:
        a, b = ask.about["f1"], ask.about["f2"]
        wa, wb = F.get(_fields_of(a), 0), F.get(_fields_of(b), 0)
        return answer(noul=marked(F.lower(b), F.when((wa == wb) & (wa != ""), F.lit(YES)).otherwise(F.lit(NO))))

    return ExprJudge(noul)


def equal_texts() -> ExprJudge:
    """Two records mean the same if they are equal."""
    return ExprJudge(lambda ask: answer(noul=F.when(ask.about["f1"] == ask.about["f2"], F.lit(YES)).otherwise(F.lit(NO))))


def new_marker(word: str = "NEW") -> ExprJudge:
    """A segment begins where the record holds the word."""
    return ExprJudge(lambda ask: answer(noul=marked(ask.about["f2"], F.when(ask.about["f2"].contains(word), F.lit(YES)).otherwise(F.lit(NO)))))


def lowercase_start() -> ExprJudge:
    """A line continues the one before if it starts with a small letter."""

    def noul(ask: Ask) -> Column:
        b = F.regexp_replace(ask.about["f2"], "^[ \\t>]+", "")
        return answer(noul=marked(b, F.when(b.rlike("^\\p{Ll}"), F.lit(0.9)).otherwise(F.lit(NO))))

    return ExprJudge(noul)


def answer_marker() -> ExprJudge:
    """Lines with ANSWER fit, with PARTIAL half, with UNSURE a little."""

    def noul(ask: Ask) -> Column:
        t = ask.subject()
        return answer(noul=F.when(t.contains("ANSWER"), F.lit(0.9)).when(t.contains("PARTIAL"), F.lit(0.6)).when(t.contains("UNSURE"), F.lit(0.3)).otherwise(F.lit(0.01)))

    return ExprJudge(noul, default_choice)


def number_order(bias: float = 0.0) -> ExprJudge:
    """Orders by the first number of a text: a seed level per five, and pairs by comparison (or a constant bias)."""

    def number(c: Column) -> Column:
        return F.regexp_extract(c, r"(\d+)", 1).try_cast("bigint")

    def score(ask: Ask) -> Column:
        level = F.least(F.lit(len(ask.levels) - 1).cast("bigint"), F.floor(number(ask.subject()) / 5))
        return answer(score=level.cast("double"), confidence=F.lit(1.0))

    def noul(ask: Ask) -> Column:
        p = F.lit(bias) if bias > 0 else F.when(number(ask.about["a"]) < number(ask.about["b"]), F.lit(YES)).otherwise(F.lit(NO))
        return answer(noul=p)

    return ExprJudge(noul, None, score)
