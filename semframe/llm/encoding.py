"""Finding and restoring text that was decoded with a wrong character encoding.

Method: for each legacy encoding, characters are mapped *back to bytes*, a *byte-structure automaton* finds the maximal
well-formed multibyte spans among them, and only those spans are decoded; this repeats while it finds something, so text
damaged any number of times comes back too.  A span counts if it decodes to a character that texts hold, and if it is not something a
sound text may show by chance (a capital before a closing quote, say, or two box-drawing characters).

A single-byte text read as another single-byte encoding has no multibyte structure.  There the same maps are used, and
what decides is the words: a run of letters that no alphabet joins and that decodes to words of one script; or, for Latin
alphabets, words that turn into words which the corpus itself uses undamaged in more documents (the word statistics cover
all documents).

Not a case: a damaged word beside the right one (the text shows the damage on purpose), and unusual characters that are
meant.  U+FFFD inside a text is a case that cannot be restored.

Defined cases: null, empty and plain ASCII texts are sound and never reach Python; a text of any length is examined whole;
rows with the same id are examined one by one.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semframe.session import durable

#: How far from a damaged word the right one may stand for the pair to be deliberate.
BESIDE = 48
#: A word that the corpus uses in fewer documents is no evidence, nor one used less than so many times the damaged form.
MIN_DOCS, MIN_RATIO = 2, 3
#: How damage is found: the byte automaton; its look-alike for text in lower case; letters of another script; words of the
#: corpus; bytes that were lost.
AUTOMATON, LOWER, SCRIPT, WORDS, LOST = "automaton", "lower case", "script", "words", "lost bytes"

# Names of encodings.  Text of MULTIBYTE structure read by one of these comes back by its bytes alone.
READ_AS = ("w1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp437", "cp850", "mac_roman", "iso8859_2", "koi8_r", "cp866", "cp852")
READ_AS_WIDE = ("gbk", "cp932", "big5", "cp949")
# (true encoding, encoding it was read by) of single-byte Latin texts, told by words
LATIN_PAIRS = (
    ("cp1250", "w1252"), ("iso8859_2", "w1252"), ("cp1254", "w1252"), ("w1252", "cp437"), ("w1252", "cp850"), ("w1252", "mac_roman"),
    ("w1252", "cp1250"), ("w1252", "cp1251"), ("w1252", "cp1253"), ("mac_roman", "w1252"), ("cp437", "w1252"), ("cp850", "w1252"),
    ("cp1250", "cp437"), ("cp1250", "cp850"), ("cp852", "w1252"), ("cp1250", "cp852"), ("iso8859_2", "cp1250"), ("cp1250", "iso8859_2"),
    ("w1252", "iso8859_2"), ("cp1254", "cp1250"), ("cp1254", "cp437"), ("cp1250", "mac_roman"), ("cp1254", "mac_roman"), ("cp1250", "cp1251"), ("cp1254", "cp1251"),
)
CYRILLIC_TRUE = ("cp1251", "koi8_r", "cp866", "mac_cyrillic", "iso8859_5")
GREEK_TRUE = ("cp1253", "iso8859_7")
WIDE_TRUE = ("gbk", "cp932", "euc_jp", "big5")
# letters that make up most of a text
COMMON_CYRILLIC, COMMON_GREEK = set("оеаинтсрвлкмдпу"), set("αοιετσνηυρπκμλάόίέή")
# characters that may follow a word without a space
LIGHT_LINES = set("─│┌┐└┘├┤┬┴┼")
CLOSING = set("…”’»“‘«–—›‹„‚ \u00a0\u2028")


@lru_cache(maxsize=None)
def byte_of(name: str) -> dict[str, int]:
    """Character to byte, 0x80 and above, of a single-byte encoding; bytes it does not define stand for the C1 controls."""
    out: dict[str, int] = {}
    base = "cp1252" if name == "w1252" else name
    for b in range(0x80, 0x100):
        if name == "w1252":
            out[chr(b)] = b
    for b in range(0x80, 0x100):
        try:
            ch = bytes([b]).decode(base)
        except UnicodeDecodeError:
            ch = chr(b)
        out.setdefault(ch, b)
        out.setdefault(chr(b), b) if b < 0xA0 else None
    return out


@lru_cache(maxsize=None)
def char_of(name: str) -> dict[int, str]:
    base = "cp1252" if name == "w1252" else name
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[b] = bytes([b]).decode(base)
        except UnicodeDecodeError:
            pass
    return out


@lru_cache(maxsize=None)
def _may_hold(name: str) -> re.Pattern:
    """A first byte of a sequence before a further byte: without this, an encoding has no span in a text."""
    table = byte_of(name)
    lead = "".join(re.escape(c) for c, b in table.items() if 0xC2 <= b <= 0xF4)
    rest = "".join(re.escape(c) for c, b in table.items() if 0x80 <= b <= 0xBF)
    return re.compile(f"[{lead}][{rest}]")


def _held(c: int) -> bool:
    """Whether texts of living languages hold the code point (letters and signs in use, not whole planes)."""
    return (
        0xA0 <= c <= 0x17F and c not in (0x132, 0x133, 0x138, 0x149, 0x17F, 0x134, 0x135) or 0x386 <= c <= 0x3CE or 0x400 <= c <= 0x45F or c in (0x490, 0x491)
        or 0x2010 <= c <= 0x203A or 0x200B <= c <= 0x200F or 0x2070 <= c <= 0x209F or 0x20A0 <= c <= 0x20BF or 0x2100 <= c <= 0x214F or 0x2190 <= c <= 0x22FF
        or 0x2500 <= c <= 0x27BF or 0x3000 <= c <= 0x30FF or 0x4E00 <= c <= 0x9FFF or 0xAC00 <= c <= 0xD7A3 or 0xFF00 <= c <= 0xFFEF
        or c in (0xFEFF, 0xFE0F, 0xFB01, 0xFB02, 0xFFFD) or 0x1F000 <= c <= 0x1FAFF or 0x1D400 <= c <= 0x1D7FF
    )


@lru_cache(maxsize=None)
def _given() -> frozenset[str]:
    """What a wrong reading gives: a text damaged twice must first come back to these."""
    return frozenset(ch for name in READ_AS for ch in char_of(name).values())


@lru_cache(maxsize=1 << 16)
def _written(ch: str) -> bool:
    """Whether the character is assigned and no control: other scripts, marks, rare letters."""
    return unicodedata.category(ch) not in ("Cc", "Cn", "Co", "Cs")


def _block(ch: str) -> int:
    """A script or part of one."""
    return ord(ch) >> 6 if ch < "\u0370" else 0x1000 + (ord(ch) >> 8)


def _sequence(b: list[int], i: int, end: int) -> int:
    """Length of the well-formed UTF-8 multibyte sequence at ``i``; 0 for none."""
    x = b[i]
    if 0xC2 <= x <= 0xDF:
        n = 2
    elif 0xE0 <= x <= 0xEF:
        n = 3
    elif 0xF0 <= x <= 0xF4:
        n = 4
    else:
        return 0
    if i + n > end:
        return 0
    for k in range(1, n):
        if not 0x80 <= b[i + k] <= 0xBF:
            return 0
    y = b[i + 1]
    if (x == 0xE0 and y < 0xA0) or (x == 0xED and y > 0x9F) or (x == 0xF0 and y < 0x90) or (x == 0xF4 and y > 0x8F):
        return 0
    return n


class Spans:
    """Decodable spans of a text under one encoding: ``(from, to, decoded)`` in characters, and how many are evidence."""

    def __init__(self) -> None:
        self.found: list[tuple[int, int, str]] = []
        self.strong = 0

    def __len__(self) -> int:
        return len(self.found)


def _box(ch: str) -> bool:
    return "\u2500" <= ch <= "\u259f"


def _unlikely(text: str, s: int, e: int, name: str, lead_byte: int) -> bool:
    """Whether the characters of a decodable span would not stand side by side in a sound text."""
    lead, rest = text[s], text[s + 1 : e]
    before = text[s - 1] if s else " "
    after = text[e] if e < len(text) else " "
    if lead in "–—":
        return False
    if (lead + rest).isalpha():  # letters may follow letters, but not a capital a small letter
        inside = before + lead + rest
        if any(x.islower() and y.isupper() for x, y in zip(inside, inside[1:])):
            return True
        if len({min(ord(c) // 0x100, 4) if c >= "\u0370" else 0 for c in lead + rest}) > 1:  # of two scripts
            return True
        if len(rest) == 2 and lead_byte == 0xE2 and name in ("cp437", "cp850", "mac_roman"):  # a dash or quote as three accented letters in a row, and just three
            return not any(c.isalpha() and c > "\x7f" for c in before + after)
        return len(rest) == 1 and 0xC2 <= lead_byte <= 0xC5 and name in ("w1252", "cp1250", "cp1254", "iso8859_2")
    if _box(lead) and all(map(_box, rest)):  # drawings use the light lines, and stand apart from words
        return any(c not in LIGHT_LINES for c in rest) or before.isalnum() or after.isalnum()
    if all(c in CLOSING for c in rest):  # a letter before a closing sign, unless the word goes on
        if lead == "Â" and rest == "\u00a0":
            return True
        return len(rest) == 1 and after.isalpha() and rest not in "“«‘„‚—–"
    return True


def _in_word(text: str, s: int, e: int, ch: str) -> bool:
    """Whether a span alone stands for a Latin letter or a mark within a word, where a capital and a sign would not."""
    if not (ch < "\u0250" or "\u0300" <= ch <= "\u036f") or not (text[s].isupper() or _box(text[s])):
        return False
    if s and text[s - 1].islower():
        return True
    return e < len(text) and text[e].islower() and not all(c in CLOSING for c in text[s + 1 : e])


def _narrow_spans(text: str, name: str, runs: list[tuple[int, int]]) -> Spans:
    """Characters of ``_held`` are taken wherever they decode.  Others by chance stand alone, so they are evidence only beside
    another span or within a word, and those no wrong reading gives are taken only where their script has such evidence."""
    table, back, out = byte_of(name), char_of(name), Spans()
    rare: list[tuple[int, int, str]] = []
    scripts: set[int] = set()
    for a, z in runs:
        b = [table.get(ch, 0) for ch in text[a:z]]
        n, i, every = z - a, 0, []
        while i < n:
            k = _sequence(b, i, n) if b[i] >= 0xC2 else 0
            if k:
                ch = bytes(b[i : i + k]).decode("utf-8")
                if _held(ord(ch)) or (k == 2 and b[i] == 0xC2 and (name == "w1252" or b[i + 1] < 0xA0 and b[i + 1] not in back)):
                    every.append((a + i, a + i + k, ch, 0))
                    i += k
                    continue
                if (ch in _given() or _written(ch)) and not all(map(_box, text[a + i : a + i + k])):
                    every.append((a + i, a + i + k, ch, 1 if ch in _given() else 2))
                    i += k
                    continue
            i += 1
        chain = [(s, e, ch) for s, e, ch, tier in every if not tier]
        strong = sum(_unlikely(text, s, e, name, b[s - a]) for s, e, _ in chain)
        if not strong and len(chain) >= 3:
            chars = "".join(text[s:e] for s, e, _ in chain)
            strong = int(not all(map(_box, chars)) and not chars.isalpha())
        for at, (s, e, ch, tier) in enumerate(every):
            if not tier:
                continue
            (chain if tier == 1 else rare).append((s, e, ch))
            if text[s] >= "\u0370" and text[s:e].isalpha():  # Cyrillic or Greek letters in any order and case
                continue
            beside = [x for x in every[max(0, at - 1) : at + 2] if x[0] == e or x[1] == s]
            if tier == 2:
                beside = [x for x in beside if x[3] == 2 and _block(x[2]) == _block(ch)]
            if (beside or tier == 2 and e - s > 2 or _in_word(text, s, e, ch)) and _unlikely(text, s, e, name, b[s - a]):
                strong += 1
                scripts.add(_block(ch))
        out.found += chain
        out.strong += strong
    out.found = sorted(out.found + [x for x in rare if _block(x[2]) in scripts])
    return out


# what is left of a damaged text in lower case: the leads of two-byte sequences have become other letters
_LOWER_LEAD = {"ã": 0xC3, "â": 0xC2, "ä": 0xC4, "å": 0xC5, "î": 0xCE, "ï": 0xCF, "ð": 0xD0, "ñ": 0xD1}
_LOWER_REST = {"š": 0x8A, "œ": 0x8C, "ž": 0x8E, "ÿ": 0x9F}


def _lower_spans(text: str, runs: list[tuple[int, int]]) -> Spans:
    table, out = byte_of("w1252"), Spans()
    for a, z in runs:
        i = a
        while i + 1 < z:
            lead, c = _LOWER_LEAD.get(text[i]), text[i + 1]
            b = _LOWER_REST.get(c, table.get(c, 0))
            if lead and 0x80 <= b <= 0xBF:
                ch = bytes([lead, b]).decode("utf-8")
                if _held(ord(ch)):
                    out.found.append((i, i + 2, ch))
                    out.strong += c not in CLOSING and not c.isalpha() and b < 0xC0
                    i += 2
                    continue
            i += 1
    return out


def _wide_spans(text: str, name: str, runs: list[tuple[int, int]]) -> Spans:
    """Multibyte readings: a run is a span if its bytes are almost wholly well-formed."""
    out = Spans()
    for a, z in runs:
        run = text[a:z]
        try:
            raw = list(run.encode(name))
        except UnicodeEncodeError:
            good = []
            for ch in run:
                try:
                    good.append(ch.encode(name))
                except UnicodeEncodeError:
                    good.append(b"\x00")
            raw = list(b"".join(good))
        n, i, covered, decoded, odd = len(raw), 0, 0, [], 0
        while i < n:
            k = _sequence(raw, i, n) if raw[i] >= 0xC2 else 0
            if k:
                ch = bytes(raw[i : i + k]).decode("utf-8")
                decoded.append(ch)
                odd += not _held(ord(ch))
                covered += k
                i += k
            else:
                decoded.append(chr(raw[i]) if raw[i] < 0x80 else "\ufffd")
                i += 1
        if not covered or odd:
            continue
        before = text[a - 1] if a else " "
        after = text[z] if z < len(text) else " "
        latin = lambda c: c.isascii() and c.isalpha()
        if covered >= 0.75 * n and len(run) >= 3 and covered >= 6:
            strong = 1
        elif covered >= n - 1 and len(run) <= 3 and any("\u00c0" <= c <= "\u00ff" or "\u2010" <= c <= "\u203a" or c == "€" for c in decoded):
            strong = 1 if latin(before) and latin(after) else 0  # evidence only within a Latin word
        else:
            continue
        out.found.append((a, z, "".join(decoded)))
        out.strong += strong
    return out


def _runs(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer("[^\x00-\x7f\ufffd]+", text)]


def _wide_runs(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer("[^\x00-\x7f\ufffd]+", text) if any(c >= "\u2e80" or "\uff61" <= c <= "\uff9f" for c in m.group())]


def _word(text: str, a: int, z: int) -> tuple[int, int]:
    stop = set(" \t\n\r|\"'“”‘’()[]{},;:=/<>`*")
    while a > 0 and text[a - 1] not in stop:
        a -= 1
    while z < len(text) and text[z] not in stop:
        z += 1
    return a, z


def _replace(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, z, ch in spans:
        out += [text[at:a], ch]
        at = z
    return "".join(out) + text[at:]


def _deliberate(text: str, spans: list[tuple[int, int, str]]) -> set[int]:
    """Spans whose word stands beside its right form in the same line."""
    words: dict[tuple[int, int], list[int]] = {}
    for k, (a, z, _) in enumerate(spans):
        words.setdefault(_word(text, a, z), []).append(k)
    shown: set[int] = set()
    for (a, z), ks in words.items():
        right = _replace(text[a:z], [(spans[k][0] - a, spans[k][1] - a, spans[k][2]) for k in ks]).strip(".,!?")
        if len(right) < 2:
            continue
        lo, hi = text.rfind("\n", 0, a) + 1, text.find("\n", z)
        hi = len(text) if hi < 0 else hi
        around = text[max(lo, a - BESIDE) : a] + "\x00" + text[z : min(hi, z + BESIDE)]
        if re.search(rf"(?<!\w){re.escape(right)}(?!\w)", around):
            shown.update(ks)
    return shown


# --- scripts -----------------------------------------------------------------------------------------------------------
def _script_score(s: str, lo: str, hi: str, common: set[str]) -> float:
    """How much ``s`` looks like words of the script ``lo..hi``: its letters, their usual ones, natural capitals."""
    letters = [c for c in s if c.isalpha()]
    if len(letters) < 3:
        return 0.0
    own = sum(lo <= c <= hi for c in letters) / len(letters)
    usual = sum(c.lower() in common for c in letters) / len(letters)
    words = re.findall(r"[^\W\d_]{2,}", s)
    cased = sum(w[1:].islower() or w.isupper() for w in words) / max(1, len(words))
    return own * (usual + cased) / 2 if own > 0.9 else 0.0


def _wide_score(s: str) -> float:
    if not s or "\ufffd" in s:
        return 0.0
    wide = [c for c in s if c > "\x7f"]
    kana = sum("\u3041" <= c <= "\u30ff" for c in wide)
    han = sum("\u4e00" <= c <= "\u9fff" for c in wide)
    signs = sum("\u3000" <= c <= "\u303f" or "\uff00" <= c <= "\uffef" for c in wide)
    return (kana + han + signs) / max(1, len(wide)) if kana + han >= 3 else 0.0


_LETTER_RUN = re.compile("[\u00c0-\u00ff\u00b8\u00a8\u00b3\u00bf\u00a2\u0152\u0153\u0160\u0161\u017d\u017e\u0178\u0192\u0080-\u009f]{3,}")
_RARE_CYRILLIC = re.compile("[\u0400\u0402-\u040f\u0450\u0452-\u045f\u0490\u0491]")
_CYRILLIC_WORD = re.compile("[\u0400-\u045f]{2,}")


def _line_script(line: str, first: bool = False) -> tuple[str, str, str] | None:
    """``(restored, true encoding, read as)`` of a line whose letters belong to another script; None for a sound line.
    ``first``: before multibyte spans are looked for, only what cannot be one."""
    runs = [] if first else [m.group() for m in _LETTER_RUN.finditer(line)]
    clear = [r for r in runs if len(r) >= 3 and not any(c in "×÷" for c in r[:0])]
    if clear and (len(clear) >= 2 or len(clear[0]) >= 5):
        table = byte_of("w1252")
        probe = " ".join(clear)
        best = (0.7, "", "")
        for names, lo, hi, common in ((CYRILLIC_TRUE, "\u0400", "\u045f", COMMON_CYRILLIC), (GREEK_TRUE, "\u0384", "\u03ce", COMMON_GREEK)):
            for k, true in enumerate(names):
                back = char_of(true)
                s = "".join(back.get(table[c], "\ufffd") if c in table and c > "\x7f" else c for c in probe)
                if (score := _script_score(s, lo, hi, common) - 0.02 * k) > best[0]:
                    best = (score, true, "n")
        for true in WIDE_TRUE:
            s = "".join(bytes(table[c] for c in r).decode(true, "replace") for r in clear if all(c in table for c in r) and len(r) % 2 == 0)
            if _wide_score(s) > 0.95 and best[0] < 0.8:
                best = (0.95, true, "w")
        if best[1] and best[2] == "n":
            back = char_of(best[1])
            return "".join(back.get(table[c], c) if c > "\x7f" and c in table else c for c in line), best[1], "w1252"
        if best[1]:
            done = _wide_line(line, best[1])
            if done:
                return done, best[1], "w1252"
    if (line.count("‚") >= 3 or sum(c in "\u0081\u0082\u0083" for c in line) >= 3) and not _well_formed(line) and not _mostly_spans(line):
        for true in ("cp932",):
            done = _wide_line(line, true)
            if done and sum("\u3041" <= c <= "\u3096" for c in done) >= 4 and _wide_score(done) >= 0.9 and not _CONTROLS.search(done):
                return done, true, "w1252"
    words = _CYRILLIC_WORD.findall(line)
    if sum(map(len, words)) >= 6 and not (first and _RARE_CYRILLIC.search(line)):
        s = " ".join(words)
        now = _script_score(s, "\u0400", "\u045f", COMMON_CYRILLIC)
        if now < 0.72:
            best = (max(0.8, now + 0.15), "", "")
            for read in ("cp1251", "koi8_r", "cp866", "mac_cyrillic"):
                table = byte_of(read)
                for true in CYRILLIC_TRUE:
                    if true == read:
                        continue
                    back = char_of(true)
                    t = "".join(back.get(table[c], "\ufffd") if c in table and c > "\x7f" else c for c in s)
                    if (score := _script_score(t, "\u0400", "\u045f", COMMON_CYRILLIC)) > best[0]:
                        best = (score, true, read)
            if best[1]:
                table, back = byte_of(best[2]), char_of(best[1])
                return "".join(back.get(table[c], c) if c > "\x7f" and c in table else c for c in line), best[1], best[2]
    return None


_CONTROLS = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def _mostly_spans(line: str) -> bool:
    """Whether well-formed multibyte spans make up most of the line's characters beyond ASCII: then it is no other encoding."""
    spans = _narrow_spans(line, "w1252", _runs(line)).found
    return sum(z - a for a, z, _ in spans) > 0.5 * sum(c > "\x7f" for c in line)


def _well_formed(line: str) -> bool:
    """Whether the bytes of the line are UTF-8 throughout, as other multibyte text is not."""
    table = byte_of("w1252")
    try:
        return bool(bytes(ord(c) if c < "\x80" else table.get(c, 0xFF) for c in line).decode("utf-8"))
    except UnicodeDecodeError:
        return False


def _wide_line(line: str, true: str) -> str:
    table = byte_of("w1252")
    raw = bytearray()
    for c in line:
        if c < "\x80":
            raw.append(ord(c))
        elif c in table:
            raw.append(table[c])
        else:
            return ""
    s = bytes(raw).decode(true, "replace")
    bad = s.count("\ufffd")
    return s if bad <= 0.05 * max(1, sum(c > "\x7f" for c in s)) else ""


def _scripts(text: str, first: bool = False) -> tuple[str, str | None]:
    """The text with the lines restored that belong to another script, and what they were."""
    lines, changed = text.split("\n"), None
    for i, line in enumerate(lines):
        if not line.isascii() and (hit := _line_script(line, first)):
            lines[i], changed = hit[0], f"{hit[1]} read as {hit[2]}"
    return ("\n".join(lines), changed) if changed else (text, None)


def examine(text: str) -> tuple[str | None, str | None]:
    """``(kind, restored)`` by the structure of the text alone; ``(None, None)`` for a text without such damage.
    ``restored`` is null where bytes were lost."""
    return examined(text)[1:]


def examined(text: str) -> tuple[str | None, str | None, str | None]:
    """``(route, kind, restored)``: as ``examine``, with how the damage was found first."""
    now, kind = _scripts(text, first=True)
    route = SCRIPT if kind else None
    before: set[str] = set()
    # each pass makes the text shorter, or comes back to one it has seen: there is no number of passes
    while now not in before:
        before.add(now)
        runs = _runs(now)
        best: tuple[tuple[int, int], str, list] | None = None
        if runs:
            tries = [(n, _narrow_spans(now, n, runs)) for n in READ_AS if _may_hold(n).search(now)]
            wide = _wide_runs(now)
            if wide:
                tries += [(n, _wide_spans(now, n, wide)) for n in READ_AS_WIDE]
            tries.append(("w1252 in lower case", _lower_spans(now, runs)))
            for name, spans in tries:
                if spans.strong:
                    size = (sum(z - a for a, z, _ in spans.found), spans.strong)
                    if best is None or size > best[0]:
                        best = (size, name, spans.found)
        if best is not None and (shown := _deliberate(now, best[2])):
            rest = [s for k, s in enumerate(best[2]) if k not in shown]
            still = _narrow_spans(now, best[1], [(a, z) for a, z, _ in rest]).strong if best[1] in READ_AS else len(rest)
            best = (best[0], best[1], rest) if still else None  # evidence must remain without the deliberate ones
        if best is None:
            break
        route = route or (AUTOMATON if best[1] in byte_names() else LOWER)
        kind = kind or f"utf-8 read as {best[1]}"
        now = _replace(now, best[2])
    now, script = _scripts(now)
    route, kind = route or (SCRIPT if script else None), kind or script
    sound = now if "\ufffd" not in now and len(_CONTROLS.findall(now)) <= len(_CONTROLS.findall(text)) else None
    if "\ufffd" in text and (kind or re.search("\\w\ufffd|\ufffd\\w|\ufffd\ufffd", text)):
        return route or LOST, kind or LOST, sound
    return (route, kind, sound) if kind else (None, None, None)


def byte_names() -> tuple[str, ...]:
    return READ_AS + READ_AS_WIDE


# --- words -------------------------------------------------------------------------------------------------------------
#: Runs of letters and of what a wrong reading makes of letters, with a character beyond ASCII.
_MIXED_WORD = re.compile(r"[A-Za-z\u0080-\u00bf\u00c0-\u024f\u0370-\u03ff\u0400-\u045f\u2010-\u2030\u2039\u203a\u207f\u20a7\u20ac\u2122\u2200-\u22ff\u2300-\u23ff\u2500-\u25ff\ufb01\ufb02\uf8ff]+")


def mixed_words(text: str) -> list[str]:
    """The distinct words that mix ASCII letters with others, or hold letters of Latin alphabets beyond ASCII."""
    out = {}
    for w in _MIXED_WORD.findall(text):
        w = w.strip("…”’»“‘«–—›‹„‚\u00a0€°")
        if len(w) >= 2 and not w.isascii() and any(c.isalpha() and c < "\u0250" for c in w):
            out[w] = None
    return list(out)


def _as(word: str, table: dict[str, int], back: dict[int, str]) -> str | None:
    s = []
    for c in word:
        if c < "\x80":
            s.append(c)
        elif (b := table.get(c)) is not None and (d := back.get(b)) is not None:
            s.append(d)
        else:
            return None
    return "".join(s)


def other_readings(word: str) -> list[tuple[int, str, str]]:
    """``(priority, pair, word)`` under each pair of Latin encodings that changes the word into Latin letters."""
    out = []
    for k, (true, read) in enumerate(LATIN_PAIRS):
        w = _as(word, byte_of(read), char_of(true))
        if w and w != word:
            w = w.strip("…”’»“‘«–—›‹„‚\u00a0€°¡¿")
            core = w.replace("’", "")
            if len(core) >= 2 and core.isalpha() and not core.isascii() and all(c < "\u0250" for c in core):
                out.append((-k, f"{true} read as {read}", w))
    return out


def _examined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for key, text in zip(batch["key"], batch["text"]):
            route, kind, restored = examined(text)
            rows.append((key, route, kind, restored, [] if kind else mixed_words(text)))
        yield pd.DataFrame(rows, columns=["key", "route", "kind", "restored", "words"])


def _readings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(w, n, pair, r, k) for w, n in zip(batch["word"], batch["n"]) for k, pair, r in other_readings(w)]
        yield pd.DataFrame(rows, columns=["word", "n", "pair", "reading", "place"])


def _reread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for text, pair, words in zip(batch["text"], batch["pair"], batch["words"]):
            true, read = pair.split(" read as ")
            table, back, hits = byte_of(read), char_of(true), set(words)
            lines = text.split("\n")
            for i, line in enumerate(lines):
                if any(w in line for w in hits):
                    lines[i] = "".join(d if c > "\x7f" and c in table and (d := back.get(table[c], c)) > "\x9f" else c for c in line)
            out.append("\n".join(lines))
        yield pd.DataFrame({"key": batch["key"], "route": WORDS, "kind": batch["pair"], "restored": out})


def repair(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, route, kind, restored`` of every damaged row of ``docs``; ``restored`` is null where it cannot be recovered."""
    kind = dict(docs.dtypes)[key]
    some = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").rlike("[^\\x00-\\x7F]"))
    # read three times below: once written, most rows hold a few words
    seen = durable(some.mapInPandas(_examined, f"key {kind}, route string, kind string, restored string, words array<string>"))
    by_structure = seen.where(F.col("kind").isNotNull()).select("key", "route", "kind", "restored")

    of_doc = seen.where(F.col("kind").isNull()).select("key", F.explode("words").alias("word"))
    counted = of_doc.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    # distinct words only: the readings of a word, kept where the corpus uses the reading more
    readings = counted.mapInPandas(_readings, "word string, n bigint, pair string, reading string, place int")
    used = counted.select(F.col("word").alias("reading"), F.col("n").alias("used"))
    good = readings.join(used, "reading").where((F.col("used") >= MIN_DOCS) & (F.col("used") >= MIN_RATIO * F.col("n"))).select("word", "pair", "place", "used")
    votes = of_doc.join(good, "word").groupBy("key", "pair", "place").agg(F.count(F.lit(1)).alias("hits"), F.sum("used").alias("used"), F.collect_set("word").alias("words"))
    chosen = votes.groupBy("key").agg(F.max(F.struct("hits", "used", "place", "pair", "words")).alias("v")).select("key", "v.pair", "v.words")
    by_words = some.join(chosen, "key").select("key", "text", "pair", "words").mapInPandas(_reread, f"key {kind}, route string, kind string, restored string")
    return by_structure.unionByName(by_words).withColumnRenamed("key", key)
