"""Notations of the edit operator, translated on the driver: RE2 patterns, character sets, replacement templates."""

from __future__ import annotations

import re

# The POSIX classes a set may name, over ASCII.
POSIX = {
    "alnum": "A-Za-z0-9", "alpha": "A-Za-z", "blank": " \t", "digit": "0-9",
    "lower": "a-z", "punct": "!-/:-@[-`{-~", "space": " \t\n\v\f\r", "upper": "A-Z",
}
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\"}


def re2_to_java(pattern: str) -> str:
    """A pattern with RE2's meaning, for Java's engine: ``$`` is the end of the text, ``.`` excludes only the newline,
    ``\\s`` has no vertical tab; what RE2 refuses (look-around, back-references, possessive repeats) is refused."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if i + 1 == len(pattern):
                raise ValueError("a trailing backslash")
            n = pattern[i + 1]
            if n.isdigit() and n != "0" or n == "k":
                raise ValueError("back-references are not supported")
            if n == "z":
                out.append("\\z")
            elif n == "s":
                out.append("\\t\\n\\f\\r " if in_class else "[\\t\\n\\f\\r ]")
            elif n == "S" and not in_class:
                out.append("[^\\t\\n\\f\\r ]")
            elif n == "Q":
                end = pattern.find("\\E", i + 2)
                end = len(pattern) if end < 0 else end
                out.append(re.escape(pattern[i + 2 : end]))
                i = end + 2
                continue
            elif n == "C":
                raise ValueError("\\C is not supported")
            else:
                out.append("\\" + n)
            i += 2
            continue
        if in_class:
            if c == "[" and (m := re.match(r"\[:(\^?)(\w+):\]", pattern[i:])):
                if m[2] not in POSIX and m[2] != "word":
                    raise ValueError(f"unknown class {m[0]}")
                inner = "\\w" if m[2] == "word" else "".join("\\" + x if x in "[]\\^&`" else x for x in POSIX[m[2]])
                out.append(f"[^{inner}]" if m[1] else inner)
                i += len(m[0])
                continue
            if c in "[&":
                out.append("\\" + c)
            else:
                in_class = c != "]" or (out[-1] in ("[", "[^"))
                out.append("\\]" if c == "]" and in_class else c)
            i += 1
            continue
        if c == "[":
            in_class = True
            if pattern[i + 1 : i + 2] == "^":
                out.append("[^")
                i += 2
            else:
                out.append("[")
                i += 1
            continue
        if c == "(" and pattern[i + 1 : i + 2] == "?":
            if re.match(r"\(\?(?:[=!>]|<[=!])", pattern[i:]):
                raise ValueError("look-around is not supported")
            if m := re.match(r"\(\?P<(\w+)>", pattern[i:]):
                out.append(f"(?<{m[1].replace('_', 'U')}>")
                i += len(m[0])
                continue
        if c in "*+?}" and pattern[i + 1 : i + 2] == "+":
            raise ValueError("possessive repeats are not supported")
        out.append("\\z" if c == "$" else c)
        i += 1
    return "(?d)" + "".join(out)


def re2_to_python(pattern: str) -> str:
    """The same pattern for Python's ``regex`` module, which the span finder uses."""
    plain = re2_to_java(pattern).removeprefix("(?d)").replace("\\z", "\\Z")
    return re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", plain)


def parse_set(text: str) -> list[str]:
    """The characters of a set in order: single ones, ranges, ``\\n \\t \\r \\\\`` and ``[:class:]`` of ASCII.

    Errors: a range that runs backwards, an unknown class or escape, an empty set.
    """
    items: list[str] = []
    i = 0

    def one(i: int) -> tuple[str, int]:
        if text[i] == "\\":
            if i + 1 == len(text) or text[i + 1] not in _ESCAPES:
                raise ValueError(f"unknown escape in {text!r}")
            return _ESCAPES[text[i + 1]], i + 2
        return text[i], i + 1

    while i < len(text):
        if m := re.match(r"\[:(\w+):\]", text[i:]):
            if m[1] not in POSIX:
                raise ValueError(f"unknown class {m[0]}")
            items += sorted(chr(c) for c in range(128) if re.match(f"[{re.escape(POSIX[m[1]]).replace(chr(92) + '-', '-')}]", chr(c)))
            i += len(m[0])
            continue
        a, j = one(i)
        if j + 1 < len(text) and text[j] == "-":
            b, k = one(j + 1)
            if ord(b) < ord(a):
                raise ValueError(f"the range {a}-{b} runs backwards")
            items += [chr(c) for c in range(ord(a), ord(b) + 1)]
            i = k
            continue
        items.append(a)
        i = j
    if not items:
        raise ValueError("an empty set")
    return items


def class_of(chars: list[str]) -> str:
    """A regular expression class of the characters."""
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in dict.fromkeys(chars)) + "]"


def translation(set1: list[str], set2: list[str]) -> dict[str, str]:
    """Character by character; a short second set repeats its last character, a repeated character keeps its last mapping."""
    padded = set2 + [set2[-1]] * max(0, len(set1) - len(set2))
    return dict(zip(set1, padded))


_TEMPLATE = re.compile(r"\$(?:\$|\{(\w+)\}|(\w+))")


def expand(templ: str, groups: list[str | None], names: dict[str, int]) -> str:
    """A replacement template: ``$1``, ``$name``, ``${1}``, ``$$``; a name takes as many word characters as follow, and an
    unknown group is empty."""

    def value(m: re.Match) -> str:
        key = m[1] or m[2]
        if key is None:
            return "$"
        k = int(key) if key.isdigit() else names.get(key, -1)
        return (groups[k] or "") if 0 <= k < len(groups) else ""

    return _TEMPLATE.sub(value, templ)
