"""Cutting oversized documents into pieces at natural boundaries.

Method: *structure-tree packing*.  Headings, blocks between blank lines, list items and lines form a tree; a node that
fits is kept whole, neighbours among the children of an oversized node are merged up to the limit from the bottom up, and
only oversized nodes are descended into.  A single line over the limit is cut after sentence ends, else at white space,
else anywhere.

Consecutive pieces share ``overlap_lines`` whole lines where the limit allows: a piece that does not begin the document is
packed with the true size of the lines before its first line, so they fit wherever they and that line fit together; where they
do not, as many of them as fit are shared.  A border inside a line shares nothing.

Defined cases
-------------
* null or empty ``lines`` give one piece without lines and est 0;
* a null or unknown protocol has no limit: one piece;
* a missing element of ``line_est`` is estimated from the text by the character weights below, a null line counts as empty;
* documents within the limit never leave the JVM; repeated rows give repeated pieces.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tokens per character by class.
LETTER, DIGIT, PUNCT, SPACE, OTHER = 0.241, 1.26, 0.849, 0.016, 0.993

_ESCAPES = re.compile(r"\x1b(?:\[[0-?]*[ -/]*[@-~]|[\]PX^_][^\x07\x1b]*(?:\x07|\x1b\\)?|[ -/]*[0-~])?")
_ATX = re.compile(r"(#{1,6})\s+\S")
_NUMBERED = re.compile(r"(\d{1,3}(?:\.\d{1,3}){0,4})\.?\s+\S")
_LIST = re.compile(r"(\s*)(?:[-*+•]|\d{1,3}[.)]|[a-z][.)])\s+")
_FENCE = re.compile(r"\s*(```|~~~)")
_SENTENCE = re.compile(r"[.!?;:…。！？；]+[\"'”’»)\]]*\s*")


#: Weight of a character by its class; ASCII controls but tab and newline weigh nothing.
_ASCII = [
    SPACE if c in " \t\n" else LETTER if c.isalpha() else DIGIT if c.isdigit() else PUNCT if c > " " and c != "\x7f" else 0.0 for c in map(chr, range(128))
]
_WEIGHT = np.array(_ASCII + [OTHER])


def weights(text: str) -> np.ndarray:
    """The weight of each character."""
    return _WEIGHT[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4"), 128)]


def weight(text: str) -> float:
    """Estimated tokens of ``text`` by character class."""
    return float(weights(text).sum())


def estimate(text: str) -> int:
    return int(weight(_ESCAPES.sub("", text))) + 1


class Node:
    """Lines ``start <= i < end`` of the document; ``kids`` partition them, or are empty for a line."""

    __slots__ = ("start", "end", "kids")

    def __init__(self, start: int, end: int, kids: list["Node"] | None = None) -> None:
        self.start, self.end, self.kids = start, end, kids or []


def _heading(lines: list[str], i: int) -> int:
    """Level of the heading at line ``i``, 0 for none."""
    text = lines[i].strip()
    if not text or len(text) > 120:
        return 0
    if m := _ATX.match(text):
        return len(m[1])
    after = lines[i + 1].strip() if i + 1 < len(lines) else ""
    if len(after) >= 3 and set(after) <= {"="}:
        return 1
    if len(after) >= 3 and set(after) <= {"-"} and not lines[i].startswith(" ") and (i == 0 or not lines[i - 1].strip()) and "|" not in text:
        return 2
    alone = (i == 0 or not lines[i - 1].strip()) and not after
    if alone and len(text) <= 80 and text[-1] not in ".,;:!?":
        if m := _NUMBERED.match(text):
            return 1 + m[1].count(".")
        if text.isupper() and any(c.isalpha() for c in text):
            return 1
        if text.istitle():
            return 2
    return 0


def _leaves(start: int, end: int) -> list[Node]:
    return [Node(i, i + 1) for i in range(start, end)]


def _nested(start: int, end: int, marks: list[tuple[int, int]]) -> list[Node]:
    """Children of ``start..end``: a node per mark ``(line, depth)``, each with the deeper ones and the lines beneath it.  One
    pass with a stack, however deep the nesting."""
    kids: list[Node] = _leaves(start, marks[0][0] if marks else end)
    open_: list[tuple[int, Node]] = []
    for k, (i, depth) in enumerate(marks):
        nxt = marks[k + 1][0] if k + 1 < len(marks) else end
        while open_ and open_[-1][0] >= depth:
            open_.pop()[1].end = i
        node = Node(i, end, _leaves(i, nxt))
        (open_[-1][1].kids if open_ else kids).append(node)
        open_.append((depth, node))
    return kids


def _listed(lines: list[str], start: int, end: int) -> list[Node]:
    """Children of a block: list items, each with the deeper items and the text beneath it; else its lines."""
    return _nested(start, end, [(i, len(m[1].expandtabs())) for i in range(start, end) if (m := _LIST.match(lines[i]))])


def _blocks(lines: list[str], start: int, end: int) -> list[Node]:
    """Blocks of a section: runs of lines up to and with the blank lines after them; a fence keeps its blank lines."""
    out, at, i, fenced = [], start, start, False
    while i < end:
        if _FENCE.match(lines[i]):
            fenced = not fenced
        blank = not lines[i].strip() and not fenced
        if blank and (i + 1 == end or lines[i + 1].strip()):
            out.append(Node(at, i + 1, _listed(lines, at, i + 1)))
            at = i + 1
        i += 1
    if at < end:
        out.append(Node(at, end, _listed(lines, at, end)))
    return out


def tree(lines: list[str]) -> Node:
    """The structure of a document: sections by heading level, blocks, list items, lines."""
    plain = [_ESCAPES.sub("", x).rstrip("\r") for x in lines]
    heads, fenced = [], False
    for i in range(len(plain)):
        if _FENCE.match(plain[i]):
            fenced = not fenced
        elif not fenced and (level := _heading(plain, i)):
            heads.append((i, level))

    # sections one by one, each hung under the last heading above its level
    root = Node(0, len(lines), _blocks(plain, 0, heads[0][0] if heads else len(lines)))
    open_: list[tuple[int, Node]] = [(0, root)]
    for k, (i, level) in enumerate(heads):
        end = heads[k + 1][0] if k + 1 < len(heads) else len(lines)
        body = i + 1
        while body < end and not plain[body].strip():
            body += 1
        while open_[-1][0] >= level:
            open_.pop()[1].end = i
        node = Node(i, len(lines), [Node(i, body, _leaves(i, body)), *_blocks(plain, body, end)])
        open_[-1][1].kids.append(node)
        open_.append((level, node))
    return root


def _line_parts(text: str, est: int, limit: int) -> list[tuple[int, int, int]]:
    """``(from, to, est)`` of the parts of one line, each within ``limit``: sentence ends first, then white space."""
    whole = max(weight(text), 1e-9)
    scale = max(1.0, est / (whole + 1))
    ends = [m.end() for m in _SENTENCE.finditer(text)]
    spaces = [m.end() for m in re.finditer(r"\s+", text)]
    # the running weight finds the farthest end within the limit
    acc = np.concatenate(([0.0], np.cumsum(weights(text)))).tolist()
    size = lambda a, b: int((acc[b] - acc[a]) * scale) + 1
    out, at, n = [], 0, len(text)
    while at < n:
        room = acc[at] + max((limit - 1) / scale, 0.0)
        far = max(at + 1, min(n, bisect_right(acc, room + 1e-12) - 1))
        while far > at + 1 and size(at, far) > limit:
            far -= 1
        cut = far
        if far < n:
            for stops in (ends, spaces):
                k = bisect_right(stops, far) - 1
                if k >= 0 and stops[k] > at and stops[k] - at >= (far - at) // 3:
                    cut = stops[k]
                    break
        out.append((at, cut, size(at, cut)))
        at = cut
    return out


def cut(lines: list[str], ests: list[int], limit: int, overlap: int) -> list[dict]:
    """Pieces of a document: ``first, last`` (0-based lines), ``start, stop`` (characters of a cut line, else None),
    ``shared`` lines with the piece before, and ``est``."""
    total = [0]
    for e in ests:
        total.append(total[-1] + e)
    span = lambda a, b: total[b] - total[a]
    if span(0, len(lines)) <= limit:
        return [{"first": 0, "last": len(lines) - 1, "start": None, "stop": None, "shared": 0, "est": span(0, len(lines))}]
    out: list[dict] = []
    first, end, room, used, share = 0, 0, limit, 0, (0, 0)  # the open piece: lines first..end, its own size and what it shares

    def shared_before(i: int) -> tuple[int, int]:
        """What a piece that begins with line ``i`` shares with the piece before: the lines that fit beside line ``i``."""
        if end > first:
            low = first - share[0]
        elif out and out[-1]["start"] is None:
            low = out[-1]["first"]
        else:
            return 0, 0
        n, size = 0, 0
        while n < overlap and i - n - 1 >= low and ests[i] + size + ests[i - n - 1] <= limit:
            n += 1
            size += ests[i - n]
        return n, size

    def close() -> None:
        nonlocal first, used
        if end > first:
            out.append({"first": first - share[0], "last": end - 1, "start": None, "stop": None, "shared": share[0], "est": used + share[1]})
        first, used = end, 0

    # Nodes in order, without recursion: siblings are merged into the open piece while they fit; one that fits a new piece
    # begins it; only a node too large for a piece of its own is descended into.
    todo = [tree(lines)]
    while todo:
        node = todo.pop()
        size = span(node.start, node.end)
        if used + size <= room and end > first:
            end, used = node.end, used + size
            continue
        before = shared_before(node.start)
        if size + before[1] <= limit:
            close()
            share, room = before, limit - before[1]
            end, used = node.end, size
        elif node.kids:
            todo.extend(reversed(node.kids))
        elif node.end - node.start > 1:
            todo.extend(reversed(_leaves(node.start, node.end)))
        else:
            close()
            out += [{"first": node.start, "last": node.start, "start": a, "stop": b, "shared": 0, "est": e} for a, b, e in _line_parts(lines[node.start], ests[node.start], limit)]
            first = end = node.end
    close()
    return out


SCHEMA = (
    "input_id bigint, piece int, pieces int, first_line int, last_line int, start_char int, stop_char int,"
    " shared_lines int, est bigint, lines array<string>"
)


def _cut_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        for doc, lines, given, limit, overlap in zip(batch["input_id"], batch["lines"], batch["line_est"], batch["limit"], batch["overlap"]):
            lines = ["" if x is None else x for x in lines]
            given = [] if given is None else list(given)
            ests = [int(given[i]) if i < len(given) and given[i] is not None and given[i] == given[i] else estimate(x) for i, x in enumerate(lines)]
            made = cut(lines, ests, int(limit), int(overlap))
            rows = []
            for k, p in enumerate(made):
                text = lines[p["first"] : p["last"] + 1] if p["start"] is None else [lines[p["first"]][p["start"] : p["stop"]]]
                rows.append((doc, k + 1, len(made), p["first"] + 1, p["last"] + 1, p["start"], p["stop"], p["shared"], p["est"], text))
            yield pd.DataFrame(rows, columns=names).astype({"start_char": "Int32", "stop_char": "Int32"})


def split_documents(docs: DataFrame, limits: DataFrame) -> DataFrame:
    """The pieces of every document, as ``SCHEMA``; ``first_line, last_line`` are 1-based and inclusive."""
    lim = F.broadcast(  # one row per protocol, three in all
        limits.select("protocol", F.col("ctx_state_q").cast("bigint").alias("limit"), F.coalesce(F.col("overlap_lines").cast("int"), F.lit(0)).alias("overlap"))
    )
    sized = (
        docs.select("input_id", "protocol", "lines", "line_est")
        .join(lim, "protocol", "left")
        .withColumn("n", F.greatest(F.size(F.coalesce("lines", F.array().cast("array<string>"))), F.lit(0)))
        .withColumn("total", F.aggregate(F.coalesce("line_est", F.array().cast("array<int>")), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0))))
        # without a full set of estimates the JVM does not decide
        .withColumn("known", F.coalesce((F.size("line_est") == F.col("n")) & ~F.exists("line_est", lambda x: x.isNull()), F.lit(False)))
    )
    whole = F.col("limit").isNull() | (F.col("n") == 0) | (F.col("known") & (F.col("total") <= F.col("limit")))
    kept = sized.where(whole).select(
        "input_id", F.lit(1).alias("piece"), F.lit(1).alias("pieces"),
        F.when(F.col("n") > 0, 1).otherwise(0).alias("first_line"), F.col("n").alias("last_line"),
        F.lit(None).cast("int").alias("start_char"), F.lit(None).cast("int").alias("stop_char"), F.lit(0).alias("shared_lines"),
        F.when(F.col("n") > 0, F.col("total")).otherwise(0).alias("est"), F.coalesce("lines", F.array().cast("array<string>")).alias("lines"),
    )
    cuts = sized.where(~whole).select("input_id", "lines", "line_est", "limit", "overlap").mapInPandas(_cut_batches, SCHEMA)
    return kept.unionByName(cuts)


def oversized(pieces: DataFrame) -> DataFrame:
    """``input_id`` of the documents that had to be cut."""
    return pieces.where(F.col("pieces") > 1).select("input_id").distinct()
