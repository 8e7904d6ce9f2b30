"""Tables of strings: delimited text with a header, ragged rows allowed; and the sinks that write them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def detect_delimiter(header: str) -> str:
    """Tab if the header has one, else comma, else semicolon, else comma."""
    return next((d for d in ("\t", ",", ";") if d in header), ",")


def cells_of(line: Column, delimiter: str) -> Column:
    """The cells of a line.  Tab: a plain split, quotes are data.  Else quotes are lazy: a quoted cell may hold the delimiter
    and doubled quotes; a quote elsewhere stands for itself."""
    if delimiter == "\t":
        return F.split(F.regexp_replace(line, "\\r\\z", ""), "\t", -1)
    d = delimiter
    cell = rf'(?:^|{d})("(?:[^"]|"")*"(?=[{d}]|$)|[^{d}]*)'
    raw = F.regexp_extract_all(F.regexp_replace(line, "\\r\\z", ""), F.lit(cell), F.lit(1))
    return F.transform(raw, lambda x: F.when(x.rlike(r'(?s)\A".*"\z'), F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))


def read_table(spark: SparkSession, path: str, delimiter: str | None = None) -> tuple[list[str], DataFrame]:
    """``(headers, rows)``: the raw header (empty and repeated names as they are) and ``num, cells``."""
    from semframe.sources.records import read_lines

    lines = read_lines(spark, [path])
    first = lines.where("num = 1").select("text").collect()
    if not first:
        return [], lines.select("num", F.array().cast("array<string>").alias("cells"))
    d = delimiter or detect_delimiter(first[0]["text"])
    head = lines.where("num = 1").select(cells_of(F.col("text"), d).alias("c")).collect()[0]["c"]
    rows = lines.where((F.col("num") > 1) & (F.col("text") != "")).select((F.col("num") - 1).alias("num"), cells_of(F.col("text"), d).alias("cells"))
    return head, rows


def read_whole_table(spark: SparkSession, path: str, delimiter: str | None = None) -> tuple[list[str], DataFrame]:
    """As ``read_table``, for files whose quoted cells hold line ends: each file is read whole, so a record may go over several
    lines; ``file, num, cells``, numbered within the file.  The header is that of the first file by name."""
    from semframe.sources.records import whole_texts

    texts = whole_texts(spark, [path]).select(F.regexp_replace("text", "\\A\\x{FEFF}", "").alias("text"))
    first = texts.select(F.regexp_extract("text", "\\A[^\\n]*", 0).alias("h")).where("h <> ''").limit(1).collect()
    if not first:
        return [], texts.select(F.lit(0).cast("bigint").alias("num"), F.array().cast("array<string>").alias("cells")).limit(0)
    d = delimiter or detect_delimiter(first[0]["h"])
    if d == "\t":
        record = "[^\\n]+"
    else:
        cell = rf'(?:"(?:[^"]|"")*"(?=[{d}\r\n]|\z)|[^{d}\n]*)'
        record = rf"(?:\A|(?<=\n))(?!\r?(?:\n|\z)){cell}(?:{d}{cell})*"
    rows = texts.select(F.posexplode(F.regexp_extract_all("text", F.lit(record), F.lit(0))).alias("num", "line"))
    head = rows.where("num = 0").select(cells_of(F.col("line"), d).alias("c")).collect()[0]["c"]
    return head, rows.where("num > 0").select(F.col("num").cast("bigint").alias("num"), cells_of(F.col("line"), d).alias("cells"))


def to_lines(rows: DataFrame, delimiter: str, cells: str = "cells") -> Column:
    """Cells as a line: tab verbatim, else quoted only where needed."""
    if delimiter == "\t":
        return F.array_join(F.col(cells), "\t")
    need = f'["{delimiter}\\r\\n]'
    quoted = F.transform(F.col(cells), lambda x: F.when(x.rlike(need), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x))
    return F.array_join(quoted, delimiter)


def write_records(df: DataFrame, path: str, mode: str = "lines", by: tuple[str, ...] = ("file_idx", "num"), text: str = "text") -> None:
    """Records in order, each followed by the separator of its mode; the parts of the folder are in order too."""
    from semframe.sources.records import SEPARATORS

    (df.repartitionByRange(*by).sortWithinPartitions(*by).select(F.col(text).alias("value")).write.mode("overwrite").option("lineSep", SEPARATORS[mode]).text(path))


def write_segments(segmented: DataFrame, path: str, group: tuple[str, ...] = ("file_idx",), text: str = "text") -> None:
    """One folder per segment, records in order."""
    (segmented.repartition(*group, "segment").sortWithinPartitions(*group, "segment", "num")
     .select(*group, "segment", F.col(text).alias("text")).write.mode("overwrite").partitionBy(*group, "segment").text(path))
