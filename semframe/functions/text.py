"""Column functions on text: cleaning, clipping, trimming, token estimates."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Estimated tokens per character, by class.
WEIGHTS = {"letter": 0.241, "digit": 1.26, "punct": 0.849, "space": 0.016, "other": 0.993}

_CLASSES = {
    "letter": "[A-Za-z]",
    "digit": "[0-9]",
    "space": "[ \\t\\n]",
    "punct": "[!-/:-@\\[-`{-~]",
    "other": "[^\\x00-\\x7F]",
}
# CSI; OSC, DCS, SOS, PM and APC strings up to BEL or ST (unterminated ones run to the end of the line); two-byte escapes
_ESCAPE = "\\x1B(?:\\[[0-?]*[ -/]*[@-~]|[\\]PX^_][^\\x07\\x1B\\n]*(?:\\x07|\\x1B\\\\)?|[ -/]*[0-Z\\\\^-~])"
_CONTROL = "[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x9F]"


def strip_escapes(c: Column) -> Column:
    return F.regexp_replace(c, _ESCAPE, "")


def clean(c: Column) -> Column:
    """What a judge sees: no terminal escapes, no control characters but tab and newline.  Null stays null."""
    return F.regexp_replace(strip_escapes(c), _CONTROL, "")


def clip(c: Column, n: int) -> Column:
    """At most ``n`` characters, the last one an ellipsis if something was cut."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def trim_space(c: Column) -> Column:
    """Without Unicode white space on either side (``trim`` strips only blanks)."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+\\z", "")


def trim_blank(c: Column, left: bool = True, right: bool = True) -> Column:
    """Without blanks and tabs on the sides named."""
    if left:
        c = F.regexp_replace(c, "^[ \\t]+", "")
    return F.regexp_replace(c, "[ \\t]+\\z", "") if right else c


def estimate(c: Column) -> Column:
    """Estimated tokens: characters by class times their weight, cut down to an integer, plus one.  Escapes cost nothing."""
    plain = strip_escapes(c)
    total = F.lit(0.0)
    for name, pattern in _CLASSES.items():
        total = total + F.regexp_count(plain, F.lit(pattern)) * F.lit(WEIGHTS[name])
    return (F.floor(total) + 1).cast("int")


def estimate_json(c: Column) -> Column:
    """Estimate of a JSON text whose writer escapes the HTML characters as six characters each."""
    for ch, code in (("<", "\\\\u003c"), (">", "\\\\u003e"), ("&", "\\\\u0026")):
        c = F.replace(c, F.lit(ch), F.lit(code.replace("\\\\", "\\")))
    return estimate(c)


def estimate_py(text: str) -> int:
    """``estimate`` on the driver."""
    plain = re.sub(_ESCAPE, "", text)
    total = sum(len(re.findall(p, plain)) * WEIGHTS[k] for k, p in _CLASSES.items())
    return int(total) + 1


#: The class of each byte of UTF-8, from 1 in the order of ``_CLASSES``; a character of several bytes counts at its first.
_OF_BYTE = np.zeros(256, np.uint8)
for _i, _pattern in enumerate(list(_CLASSES.values())[:-1], 1):
    _OF_BYTE[[ord(_c) for _c in re.findall(_pattern, "".join(map(chr, range(128))))]] = _i
_OF_BYTE[0xC0:] = len(_CLASSES)
#: Bytes of texts that ``clean`` may change: control characters, and what begins those of two bytes.
_UNCLEAN = np.zeros(256, bool)
_UNCLEAN[[*range(9), *range(0x0B, 0x20), 0x7F, 0xC2]] = True


def _weighed(counts: list):
    """Summed in the order of ``estimate``, so that both are the same to the last bit."""
    total = 0.0
    for n, weight in zip(counts, (WEIGHTS[name] for name in _CLASSES)):
        total = total + n * weight
    return np.floor(total) + 1


def estimate_plain(text: str) -> int:
    """``estimate`` of a text without escapes, in Python."""
    return int(_weighed(np.bincount(_OF_BYTE[np.frombuffer(text.encode("utf-8", "replace"), np.uint8)], minlength=len(_CLASSES) + 1)[1:]))


def estimate_json_plain(text: str) -> int:
    """``estimate_json`` in Python; a JSON text has no escapes of terminals."""
    return estimate_plain(text.replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026"))


def cleaned_estimates(texts: pa.Array) -> tuple[list[str], list[int]]:
    """``clean`` of each text (as bytes, none null), and ``estimate`` of that, for a batch at once."""
    if not len(texts):
        return [], []
    raw, wide = texts.to_pylist(), texts.cast(pa.large_binary())
    at = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = np.frombuffer(wide.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]

    def counted(hits: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(hits)))
        return sums[at[1:]] - sums[at[:-1]]

    kinds = _OF_BYTE[data]
    ests = _weighed([counted(kinds == i) for i in range(1, len(_CLASSES) + 1)]).astype(np.int64).tolist()
    seen = [t.decode("utf-8", "replace") for t in raw]
    unclean = counted(_UNCLEAN[data]) > 0
    for i, t in enumerate(seen):
        if unclean[i] or "\ufffd" in t:  # the latter may stand for bytes that are no UTF-8
            seen[i] = re.sub(_CONTROL, "", re.sub(_ESCAPE, "", t))
            ests[i] = estimate_plain(seen[i])
    return seen, ests


def tagged_id(prefix: str, n: Column, width: int = 4) -> Column:
    """``L0001``: a prefix and a zero-padded number that grows when it must."""
    s = n.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s))
