"""Records: text cut from inputs line by line, at NUL, or by paragraph, numbered within their file.

Every records frame has ``file_idx int, file string, num bigint, text string``; operators keep other columns as they are.
Numbers are exact because a file's text is one row; ``read_lines`` reads files too large for that.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINES, NUL, PARA = "lines", "nul", "para"
#: What follows each record on output.
SEPARATORS = {LINES: "\n", NUL: "\0", PARA: "\n\n"}
STDIN = "(standard input)"


def split_text(text: Column, mode: str = LINES) -> Column:
    """The records of a whole text, as an array.

    Lines end at LF, one CR before it is not part of them (but a last line without LF keeps its CR); a text has no record
    after its last terminator, and an empty text has none.  Paragraphs end at blank lines and are never empty.
    """
    if mode == NUL:
        parts = F.split(text, "\\x00", -1)
        return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    if mode == PARA:
        trimmed = F.regexp_replace(F.regexp_replace(text, "\\A[\\r\\n]+", ""), "[\\r\\n]+\\z", "")
        return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "\\r*\\n\\r?\\n[\\r\\n]*", -1))
    parts = F.split(text, "\\n", -1)
    ended = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda x: F.regexp_replace(x, "\\r\\z", ""))
    last = F.element_at(parts, -1)
    return F.when(last == "", ended).otherwise(F.concat(ended, F.array(last)))


def records_of(texts: DataFrame, mode: str = LINES, text: str = "text") -> DataFrame:
    """Records of a frame of whole texts ``file_idx, file, text``; a null text has none."""
    other = [c for c in texts.columns if c not in (text, "num")]
    return texts.select(*other, F.posexplode(split_text(F.col(text), mode)).alias("num", "text")).withColumn("num", F.col("num").cast("bigint") + 1)


def from_strings(spark: SparkSession, texts: Sequence[str], mode: str = LINES, names: Sequence[str] | None = None) -> DataFrame:
    """Records of texts at hand, each an input of its own."""
    names = names or [STDIN if len(texts) == 1 else f"{STDIN} {i}" for i in range(1, len(texts) + 1)]
    rows = [(i, n, t) for i, (n, t) in enumerate(zip(names, texts))]
    return records_of(spark.createDataFrame(rows, "file_idx int, file string, text string"), mode)


def read_records(spark: SparkSession, paths: Sequence[str], mode: str = LINES, missing: str = "error") -> tuple[DataFrame, list[str]]:
    """Records of files, in the order of ``paths``; and the files that are not there, which are an error unless ``missing``
    is ``skip``."""
    absent = [p for p in paths if not _exists(spark, p)]
    if absent and missing != "skip":
        raise FileNotFoundError(", ".join(absent))
    gone = set(absent)
    there = [(i, p) for i, p in enumerate(paths) if p not in gone]
    if not there:
        return spark.createDataFrame([], "file_idx int, file string, num bigint, text string"), absent
    return records_of(_whole(spark, there), mode), absent


def _named(spark: SparkSession, paths: Sequence[tuple[int, str]]) -> tuple[list[str], DataFrame]:
    """The distinct paths, and ``_path, file_idx, file``: which inputs a file belongs to.  A path may be given twice, and a folder
    is its files."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rows = []
    for i, p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        for f in path.getFileSystem(conf).listStatus(path):
            rows.append((re.sub(r"^(\w+):/+", r"\1:/", f.getPath().toString()), i, p))
    return list(dict.fromkeys(p for _, p in paths)), spark.createDataFrame(rows, "_path string, file_idx int, file string")


def _plain_path() -> Column:
    """The path of a row's file as Hadoop writes it: without the empty authority and percent signs of a URI."""
    return F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "^(\\w+):/+", "$1:/")


def _whole(spark: SparkSession, paths: Sequence[tuple[int, str]]) -> DataFrame:
    """``file_idx, file, text`` of files by one read of them all; a folder's files are texts of their own."""
    distinct, names = _named(spark, paths)
    got = spark.read.text(distinct, wholetext=True).select(_plain_path().alias("_path"), F.col("value").alias("text"))
    return got.join(names, "_path").select("file_idx", "file", "text")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def files_from(spark: SparkSession, list_path: str) -> list[str]:
    """Names listed in a file, one per line."""
    return [r["value"].rstrip("\r") for r in spark.read.text(list_path, wholetext=False, lineSep="\n").collect() if r["value"].strip()]


def read_lines(spark: SparkSession, paths: Sequence[str], mode: str = LINES) -> DataFrame:
    """Lines of files of any size, by one read of them all: blocks are read in parallel, numbered within, and offset by the rows
    before them."""
    distinct, names = _named(spark, list(enumerate(paths)))
    lines = spark.read.text(distinct, lineSep="\0" if mode == NUL else "\n").select(
        F.col("value").alias("text"), F.col("_metadata.file_block_start").alias("_block"), _plain_path().alias("_path"), F.monotonically_increasing_id().alias("_id"))
    where = ["file_idx", "file", "_path", "_block"]
    numbered = lines.join(names, "_path").withColumn("_in", F.row_number().over(Window.partitionBy(*where).orderBy("_id")))
    sizes = numbered.groupBy(*where).agg(F.count(F.lit(1)).alias("_n"))  # one row per block
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file_idx").orderBy("_path", "_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    text = F.regexp_replace("text", "\\r\\z", "") if mode == LINES else F.col("text")
    return (
        numbered.join(sizes.withColumn("_before", before).drop("_n"), where)
        .select("file_idx", "file", (F.col("_before") + F.col("_in")).cast("bigint").alias("num"), text.alias("text"))
    )


def whole_texts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Files as they are: ``file_idx, file, text``."""
    return _whole(spark, list(enumerate(paths)))


def with_fields(df: DataFrame, delimiter: str, text: str = "text") -> DataFrame:
    """``fields``: the positional, untyped fields of each record."""
    return df.withColumn("fields", F.split(F.col(text), re.escape(delimiter), -1))


def field(n: int) -> Column:
    """Field ``n`` from 1, empty beyond the last."""
    return F.coalesce(F.try_element_at(F.col("fields"), F.lit(n)), F.lit(""))


def with_neighbours(df: DataFrame, n: int, group: Sequence[str] = ("file_idx",), text: str = "text", num: str = "num") -> DataFrame:
    """``before`` and ``after``: up to ``n`` texts on either side within the file, nulls left out; null instead of empty, as
    encoded questions leave empty lists out.  One shuffle by blocks of the dense ``num``: a large file is not one task."""
    from semframe.operators.sequence import over_neighbours

    def side(steps):
        def lists(w):
            # numbers may have gaps: only true neighbours count
            found = F.filter(F.array(*[F.when(F.lead(num, k).over(w).between(F.col(num) - n, F.col(num) + n), F.lead(text, k).over(w)) for k in steps]), lambda x: x.isNotNull())
            return F.when(F.size(found) > 0, found)

        return lists

    return over_neighbours(df, {"before": side(range(-n, 0)), "after": side(range(1, n + 1))}, n, group, num)


def chunked(texts: DataFrame, budget: int, text: str = "text") -> DataFrame:
    """``file_idx, file, chunk, text``: each whole text in pieces of at most ``budget`` estimated tokens, cut at line ends; a
    line over the budget is cut between characters.  An empty text is one empty chunk."""
    import pandas as pd

    from semframe.functions.text import estimate_py

    def run(batches):
        for batch in batches:
            rows = []
            for i, f, t in zip(batch["file_idx"], batch["file"], batch["text"]):
                for k, c in enumerate(_chunks(t or "", budget, estimate_py)):
                    rows.append((i, f, k, c))
            yield pd.DataFrame(rows, columns=["file_idx", "file", "chunk", "text"])

    return texts.select(F.col("file_idx").cast("int"), F.col("file").cast("string"), F.col(text).alias("text")).mapInPandas(run, "file_idx int, file string, chunk int, text string")


def _chunks(text: str, budget: int, cost) -> list[str]:
    out, now, used = [], [], 0
    for line in text.splitlines(keepends=True) or [""]:
        c = cost(line)
        while c > budget:  # a line too long for a chunk of its own
            if now:
                out.append("".join(now))
                now, used = [], 0
            lo, hi = 1, len(line)
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if cost(line[:mid]) <= budget else (lo, mid - 1)
            out.append(line[:lo])
            line = line[lo:]
            c = cost(line)
        if now and used + c > budget:
            out.append("".join(now))
            now, used = [], 0
        now.append(line)
        used += c
    if now and ("".join(now) or not out):
        out.append("".join(now))
    return out


def jsonl(df: DataFrame, text: str = "text") -> DataFrame:
    """JSON lines: blank ones are left out, ``parsed`` is null where a line is not JSON; the text itself is kept."""
    return df.where(F.trim(F.col(text)) != "").withColumn("parsed", F.try_parse_json(F.col(text)))


def head_of(df: DataFrame, n: int = 20, width: int = 120, tokens: int | None = None) -> DataFrame:
    """The first ``n`` lines of each file, clipped, and of these as many as ``tokens`` allow."""
    from semframe.functions.text import clip, estimate

    head = df.where(F.col("num") <= n).withColumn("text", clip(F.col("text"), width))
    if tokens is None:
        return head
    used = F.sum(estimate(F.coalesce("text", F.lit("")))).over(Window.partitionBy("file_idx").orderBy("num"))  # at most ``n`` rows a file
    return head.withColumn("_used", used).where(F.col("_used") <= tokens).drop("_used")


def path_exists(path: str) -> bool:
    return os.path.exists(path)
