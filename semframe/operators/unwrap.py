"""Rejoin hard-wrapped lines: code settles the breaks that structure decides, a judge the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semframe.functions.text import clean, trim_blank
from semframe.operators.sequence import judge_where, running_sum, with_shifted
from semframe.operators.windows import ask_at_breaks
from semframe.plans.judge import Ask, BatchJudge, Judge

# The line kinds by pattern, and the thresholds after a dangling and after a finished line.
FENCE = r"\A {0,3}(```|~~~)"
HEADING = r"\A {0,3}#{1,6}([ \t\f\r\n]|\z)"
RULE = r"\A {0,3}[-=*_]([ \t\f\r]*[-=*_]){2,}[ \t\f\r]*\z"
LIST_ITEM = r"\A[ \t\f\r]*([-*+•‣◦]|[0-9]{1,3}[.)]|[a-zA-Z][.)])[ \t\f\r]+"
QUOTE = r"\A[ \t\f\r]*>"
TABLE = r"\A[ \t\f\r]*\|"
TERMINAL = r"[.!?:;…][\"'”’)\]]*\z"
HYPHEN = r"\p{L}-\z"
DANGLING_T, TERMINAL_T = 0.2, 0.5
# lines of a window and its estimated tokens
WINDOW, WINDOW_TOKENS = 120, 5_500

BLANK, FIXED, STARTS, PLAIN = "blank", "fixed", "starts", "plain"


def kind_of(line: Column, in_fence: Column) -> Column:
    """What structure says about a line: blank; fixed (fence and what it holds, heading, rule, table, indented code); the
    start of a list item or quote; plain.  The order matters: ``* * *`` is a rule, not an item."""
    fixed = in_fence | line.rlike(FENCE) | line.rlike(HEADING) | line.rlike(RULE) | line.rlike(TABLE) | line.startswith("\t") | line.startswith("    ")
    return (
        F.when(~line.rlike("(?U)\\S"), BLANK)
        .when(fixed, FIXED)
        .when(line.rlike(LIST_ITEM) | line.rlike(QUOTE), STARTS)
        .otherwise(PLAIN)
    )


def sem_unwrap_lines(df: DataFrame, judge: Judge, *, dangling: float = DANGLING_T, terminal: float = TERMINAL_T, group: Sequence[str] = ("file_idx",),
                     text: str = "text", context: dict[str, str] | None = None) -> DataFrame:
    """Every line with ``kind``, ``p`` (null where code decided), ``join`` onto the line before, and ``para`` from 1."""
    lines = df.withColumn("_line", F.coalesce(F.col(text), F.lit("")))
    fence = F.col("_line").rlike(FENCE).cast("int")
    lines = running_sum(lines, fence, "_fences", group)
    # inside a fence: an odd number of fence lines before this one
    lines = lines.withColumn("kind", kind_of(F.col("_line"), F.pmod(F.col("_fences") - fence, F.lit(2)) == 1))
    lines = with_shifted(lines, {"_line": "_before", "kind": "_kind_before"}, -1, group)
    settled = F.col("_before").isNull() | F.col("kind").isin(BLANK, FIXED) | F.col("_kind_before").isin(BLANK, FIXED)
    open_ = ~settled & ((F.col("kind") != STARTS) | (F.col("_line").rlike(QUOTE) & F.col("_before").rlike(QUOTE)))
    ask = Ask("noul", "Does `f2` go on with a sentence that `f1` leaves unfinished?", {"f1": clean(F.col("_before")), "f2": clean(F.col("_line"))},
              yes="The break tore a sentence apart", no="Something new begins: a sentence, an item, a heading", context=context or {})
    if isinstance(judge, BatchJudge):  # all breaks of a window in one request, the lines as its document
        judged = ask_at_breaks(lines, judge, open_, lambda tag: F.concat(F.lit("Does line "), tag, F.lit(" go on with a sentence that the line before it leaves unfinished?")),
                               group=group, text="_line", size=WINDOW, tokens=WINDOW_TOKENS, prefix="L", yes=ask.yes, no=ask.no, context=context)
    else:
        judged = judge_where(lines, judge, ask, "_answer", F.coalesce(open_, F.lit(False)))
    judged = judged.withColumn("p", F.col("_answer.noul")).withColumn("error", F.col("_answer.error"))
    limit = F.when(trim_blank(F.col("_before"), left=False).rlike(TERMINAL), F.lit(terminal)).otherwise(F.lit(dangling))
    judged = judged.withColumn("join", F.coalesce(F.col("error").isNull() & (F.col("p") >= limit), F.lit(False)))
    return running_sum(judged, (~F.col("join")).cast("int"), "para", group).drop("_answer", "_fences", "_kind_before")


def sem_unwrap(df: DataFrame, judge: Judge, *, separator: str = " ", dehyphen: bool = False, dangling: float = DANGLING_T, terminal: float = TERMINAL_T,
               group: Sequence[str] = ("file_idx",), text: str = "text", context: dict[str, str] | None = None) -> DataFrame:
    """``group, num, n, text``: the rejoined lines, numbered by their first line, with how many lines went into them.

    A joined line loses the blanks before it, and a quote that goes on its marker; the line it joins loses the blanks after
    it.  ``dehyphen`` takes out a hyphen after a letter where a small letter follows.  All other characters stay.
    """
    lines = sem_unwrap_lines(df, judge, dangling=dangling, terminal=terminal, group=group, text=text, context=context)
    # a paragraph is one row; which lines join is their place in it
    paras = lines.groupBy(*group, "para").agg(F.sort_array(F.collect_list(F.struct("num", F.col("_line").alias("line")))).alias("_l"))

    def piece(x: Column, i: Column) -> Column:
        line, joins = x["line"], i < F.size("_l") - 1
        before, after = F.get("_l", i - 1)["line"], F.get("_l", i + 1)["line"]
        own = trim_blank(line, right=False)
        own = F.when(before.rlike(QUOTE), trim_blank(F.regexp_replace(own, "\\A>", ""), right=False)).otherwise(own)
        own = F.when(i > 0, own).otherwise(line)
        cut = trim_blank(own, left=False)
        hyphen = F.lit(dehyphen) & cut.rlike(HYPHEN) & trim_blank(after, right=False).rlike("\\A\\p{Ll}")
        return F.when(~joins, own).when(hyphen, F.regexp_replace(cut, "-\\z", "")).otherwise(F.concat(cut, F.lit(separator)))

    return paras.select(*group, F.col("_l")[0]["num"].alias("num"), F.size("_l").alias("n"), F.array_join(F.transform("_l", piece), "").alias("text"))
