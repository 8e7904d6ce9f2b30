"""Edit only the occurrences that an instruction applies to; everything else stays character for character."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import StringType

from semframe.functions.regexlang import class_of, expand, parse_set, re2_to_java, re2_to_python, translation
from semframe.functions.templates import Label
from semframe.functions.text import clean
from semframe.plans.judge import Ask, Judge

SPANS = "array<struct<start:int,end:int,text:string,groups:array<string>,line:int,col:int,left:string,right:string>>"
#: Characters of the line that are shown on either side of an occurrence.
CONTEXT = 160
KEEP = "keep"


def match_spans(text: Column, *patterns: str, context: int = CONTEXT) -> Column:
    """The non-empty matches of RE2 patterns in a text, as ``SPANS``: 0-based, end exclusive, leftmost then longest, not
    overlapping, each with its 1-based line and column and the clipped rest of the line.  One pass over the text; null has none."""
    for p in patterns:
        re2_to_java(p)  # refuse what RE2 refuses

    @pandas_udf(SPANS)
    def spans(s: pd.Series) -> pd.Series:
        import regex

        compiled = [regex.compile(re2_to_python(p)) for p in patterns]
        out = []
        for t in s:
            if t is None or t is pd.NA or t != t:
                out.append([])
                continue
            found = sorted(
                ((m.start(), -m.end(), i, m) for i, c in enumerate(compiled) for m in c.finditer(t) if m.end() > m.start()), key=lambda x: x[:3]
            )
            rows, at, line, begin, seen = [], 0, 1, 0, 0
            for a, b, _, m in found:
                if a < at:
                    continue
                at = -b
                n = t.count("\n", seen, a)
                if n:
                    line, begin = line + n, t.rfind("\n", seen, a) + 1
                seen = a
                end = t.find("\n", at, at + context + 1)
                left = ("…" + t[a - context : a]) if a - begin > context else t[begin:a]
                right = t[at:end] if end >= 0 else t[at : at + context] + ("…" if len(t) > at + context else "")
                rows.append({"start": a, "end": at, "text": m.group(), "groups": [m.group(), *m.groups()], "line": line, "col": a - begin + 1, "left": left, "right": right})
            out.append(rows)
        return pd.Series(out, dtype=object)

    return spans(text)


@pandas_udf(StringType())
def _rebuilt(texts: pd.Series, edits: pd.Series) -> pd.Series:
    """The texts with their edits (sorted, not overlapping), in one pass each."""
    out = []
    for t, es in zip(texts, edits):
        if es is None or not len(es):
            out.append(t)
            continue
        parts, at = [], 0
        for e in es:
            parts += [t[at : e["start"]], e["replacement"]]
            at = e["end"]
        out.append("".join(parts) + t[at:])
    return pd.Series(out, dtype=object)


def set_pattern(set1: str, squeeze: bool = False) -> str:
    """Occurrences of a set: maximal runs, or with ``squeeze`` runs of one character, two or more."""
    chars = parse_set(set1)
    if not squeeze:
        return class_of(chars) + "+"
    return "|".join(f"\\x{{{ord(c):x}}}{{2,}}" for c in dict.fromkeys(chars))


def occurrences(texts: DataFrame, patterns: Sequence[str], key: Sequence[str] = ("file_idx",), text: str = "text", context: int = CONTEXT) -> DataFrame:
    """``key, start, end, occ, groups, line, col, around``: each match with its place and its line, the match in brackets,
    clipped on either side."""
    found = texts.select(*key, F.explode(match_spans(F.col(text), *patterns, context=context)).alias("s")).select(*key, "s.*")
    return found.withColumn("around", F.concat("left", F.lit("⟦"), "text", F.lit("⟧"), "right")).withColumnRenamed("text", "occ").drop("left", "right")


def _replacement(action: str, set1: str | None, set2: str | None, template: str | None, patterns: Sequence[str]) -> Column:
    occ = F.col("occ")
    if action == "delete":
        return F.lit("")
    if action == "squeeze":
        return F.substring(occ, 1, 1)
    if action == "translate":
        table = translation(parse_set(set1), parse_set(set2))
        return F.translate(occ, "".join(table), "".join(table.values()))
    names: dict[str, int] = {}
    if len(patterns) == 1:
        import regex

        names = dict(regex.compile(re2_to_python(patterns[0])).groupindex)

    @pandas_udf("string")
    def expanded(groups: pd.Series) -> pd.Series:
        return groups.map(lambda g: expand(template, list(g), names))

    return expanded(F.col("groups"))


def sem_edit(texts: DataFrame, judge: Judge, instruction: str, *, action: str = "replace", set1: str | None = None, set2: str | None = None,
             patterns: Sequence[str] = (), template: str | None = None, options: Sequence[str] = (), threshold: float = 0.5,
             key: Sequence[str] = ("file_idx",), text: str = "text") -> tuple[DataFrame, DataFrame]:
    """``(edited, trace)``.

    ``action``: ``translate`` set1 to set2, ``delete`` or ``squeeze`` a set (or delete matches of patterns), ``replace`` matches
    by a template, ``choose`` one of the options for each match or keep it.  An occurrence is acted on iff it was judged and
    ``p >= threshold`` (a choice: its confidence, and not ``keep``); a failed one stays.

    ``edited`` has every text with its edits and ``changed``, the number of those that differ; ``trace`` every occurrence with
    ``line, col, p, choice, acted, replacement``.  Texts without occurrences are never judged.
    """
    if action in ("translate", "squeeze") or (action == "delete" and set1 is not None):
        if action == "translate" and set2 is None:
            raise ValueError("translate needs two sets")
        patterns = [set_pattern(set1, squeeze=action == "squeeze")]
    if not patterns:
        raise ValueError("nothing to look for")
    found = occurrences(texts, patterns, key, text)
    about = {"marked": clean(F.col("occ")), "text": clean(F.col("around"))}
    if action == "choose":
        if len(set(options)) < len(options) or "" in options or KEEP in options or len(options) < 2:
            raise ValueError("options are two or more different texts, none of them empty or 'keep'")
        ask = Ask("choice", f"{instruction}: what should stand for the part of `text` in brackets?", about, options=(*[Label(o) for o in options], Label(KEEP, "leave it as it is")))
        judged = judge.attach(found, ask, "_answer").withColumn("p", F.col("_answer.confidence")).withColumn("choice", F.col("_answer.choice"))
        replacement, acts = F.col("choice"), F.col("choice") != KEEP
    else:
        ask = Ask("noul", f"Is it true that the part of `text` in brackets {instruction}?", about)
        judged = judge.attach(found, ask, "_answer").withColumn("p", F.col("_answer.noul")).withColumn("choice", F.lit(None).cast("string"))
        replacement, acts = _replacement(action, set1, set2, template, patterns), F.lit(True)
    acted = F.coalesce(F.col("_answer.error").isNull() & (F.col("p") >= threshold) & acts, F.lit(False))
    trace = judged.withColumn("acted", acted).withColumn("replacement", F.when(F.col("acted"), replacement)).withColumn("error", F.col("_answer.error")).drop("_answer", "groups", "around")
    edits = (
        trace.where((F.col("acted")) & (F.col("replacement") != F.col("occ")))
        .groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("start", "end", "replacement"))).alias("_e"))
    )
    joined = texts.join(edits, list(key), "left").withColumn("_e", F.coalesce("_e", F.array().cast("array<struct<start:int,end:int,replacement:string>>")))
    edited = joined.withColumn("changed", F.size("_e")).withColumn(text, F.when(F.size("_e") > 0, _rebuilt(F.col(text), F.col("_e"))).otherwise(F.col(text))).drop("_e")
    return edited, trace
