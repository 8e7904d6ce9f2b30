"""Driver-side mini-languages: question templates, question specs, labels, bands, delimiters, retries of notation."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

MAX_OPTIONS = 255
MAX_LEVELS = 10

_PLACEHOLDER = re.compile(r"\{(\d*)\}")


@dataclass(frozen=True)
class Label:
    """An option of a choice: its key, and what it means if that was said."""

    name: str
    description: str | None = None


@dataclass(frozen=True)
class Spec:
    """A parsed question: ``kind`` is noul, choice or score."""

    name: str
    kind: str
    question: str
    options: tuple[Label, ...] = field(default=())
    levels: tuple[str, ...] = field(default=())


def has_placeholder(q: str) -> bool:
    return bool(_PLACEHOLDER.search(q))


def rewrite_placeholders(q: str) -> str:
    """``{}`` names the text, ``{N}`` its field N."""
    return _PLACEHOLDER.sub(lambda m: f"`f{m[1]}`" if m[1] else "`text`", q)


def template(query: str) -> str:
    """The question asked of each record: a query with placeholders as it is, a question about the text, or a predicate."""
    q = query.strip()
    if has_placeholder(q):
        return rewrite_placeholders(q)
    if q.endswith("?"):
        return f"Regarding `text`: {q}"
    return f"Is it true that `text` {q.removesuffix('.')}?"


def check_placeholders(q: str, fields: bool, whole: bool = True, most: int | None = None) -> None:
    """Raise if a placeholder names something that is not there."""
    for m in _PLACEHOLDER.finditer(q):
        if not m[1]:
            if not whole:
                raise ValueError("{} is not allowed here")
        elif not fields:
            raise ValueError(f"{m[0]} needs a delimiter")
        elif int(m[1]) < 1 or (most is not None and int(m[1]) > most):
            raise ValueError(f"{m[0]} is out of range")


_BRACKET = re.compile(r"^(.*?)\s*\[([^\[\]]*\|[^\[\]]*)\]\s*$", re.S)
_ANGLE = re.compile(r"^(.*?)\s*<([^<>]*\|[^<>]*)>\s*$", re.S)
_NAME = re.compile(r"^([A-Za-z_][\w.-]*):\s+(.*)$", re.S)


def parse_label(text: str) -> Label:
    name, eq, description = text.strip().partition("=")
    if not name.strip():
        raise ValueError("an option needs a name")
    return Label(name.strip(), description.strip() or None if eq else None)


def parse_labels(items: list[str]) -> list[Label]:
    """Options in order; a repeated name or more than a choice can hold is an error."""
    labels = [parse_label(x) for x in items]
    names = [x.name for x in labels]
    if len(set(names)) < len(names):
        raise ValueError("an option is named twice")
    if len(labels) > MAX_OPTIONS:
        raise ValueError(f"more than {MAX_OPTIONS} options")
    return labels


def parse_label_file(text: str) -> list[Label]:
    """``label<TAB>description`` per line; blank lines and lines that begin with ``#`` are skipped."""
    out = []
    for line in text.splitlines():
        if line.strip() and not line.startswith("#"):
            name, _, description = line.partition("\t")
            out.append(Label(name.strip(), description.strip() or None))
    if len({x.name for x in out}) < len(out):
        raise ValueError("an option is named twice")
    return out


def parse_spec(text: str, number: int = 1) -> Spec:
    """``name: question``, with ``[a|b=what it means]`` a choice, with ``<low|high>`` a score; names default to q1, q2, …"""
    name, q = f"q{number}", text.strip()
    if m := _NAME.match(q):
        name, q = m[1], m[2].strip()
    if m := _BRACKET.match(q):
        return Spec(name, "choice", m[1].strip(), options=tuple(parse_labels(m[2].split("|"))))
    if m := _ANGLE.match(q):
        levels = tuple(x.strip() for x in m[2].split("|"))
        if len(levels) > MAX_LEVELS:
            raise ValueError(f"more than {MAX_LEVELS} levels")
        return Spec(name, "score", m[1].strip(), levels=levels)
    if not q:
        raise ValueError("an empty question")
    return Spec(name, "noul", q)


def parse_specs(texts: list[str]) -> list[Spec]:
    specs = [parse_spec(t, i) for i, t in enumerate(texts, 1)]
    if len({s.name for s in specs}) < len(specs):
        raise ValueError("two questions have one name")
    return specs


def parse_question_json(text: str) -> list[Spec]:
    """Questions of a JSON object ``{name: {type, instructions, criteria}}``, in its order; an unknown type is an error."""
    import json

    out = []
    for name, q in json.loads(text).items():
        kind, criteria = q.get("type"), q.get("criteria")
        said = q.get("instructions", "")
        said = said if isinstance(said, str) else json.dumps(said, ensure_ascii=False)
        if kind == "noul":
            out.append(Spec(name, kind, said))
        elif kind == "choice":
            out.append(Spec(name, kind, said, options=tuple(Label(k, v or None) for k, v in criteria.items())))
        elif kind == "score":
            out.append(Spec(name, kind, said, levels=tuple(criteria)))
        else:
            raise ValueError(f"{name}: unknown question type {kind!r}")
    return out


def parse_band(text: str) -> tuple[float, float]:
    """``LO:HI`` with 0 <= LO <= HI <= 1."""
    lo, sep, hi = text.partition(":")
    try:
        band = float(lo), float(hi)
    except ValueError:
        raise ValueError(f"a band is LO:HI, not {text!r}") from None
    if not sep or not 0 <= band[0] <= band[1] <= 1:
        raise ValueError(f"a band is LO:HI with 0 <= LO <= HI <= 1, not {text!r}")
    return band


def unescape_delimiter(text: str) -> str:
    return re.sub(r"\\([tn0\\])", lambda m: {"t": "\t", "n": "\n", "0": "\0", "\\": "\\"}[m[1]], text)


@dataclass
class TreeNode:
    """A label of a taxonomy."""

    name: str
    description: str | None
    children: list["TreeNode"]


def parse_taxonomy(text: str) -> list[TreeNode]:
    """An indented outline, ``name[=description]`` per line: a tab counts 4, a blank 1; ``#`` lines and blank lines are skipped.

    Errors: a name with ``/``, two siblings of one name, more than 255 children.
    """
    roots: list[TreeNode] = []
    stack: list[tuple[int, list[TreeNode]]] = [(-1, roots)]
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        lead = line[: len(line) - len(line.lstrip(" \t"))]
        depth = sum(4 if c == "\t" else 1 for c in lead)
        label = parse_label(line)
        if "/" in label.name:
            raise ValueError(f"{label.name!r}: a label may not hold a slash")
        while stack[-1][0] >= depth:
            stack.pop()
        siblings = stack[-1][1]
        if any(x.name == label.name for x in siblings):
            raise ValueError(f"{label.name!r} is there twice")
        node = TreeNode(label.name, label.description, [])
        siblings.append(node)
        if len(siblings) > MAX_OPTIONS:
            raise ValueError(f"more than {MAX_OPTIONS} labels under one parent")
        stack.append((depth, node.children))
    if not roots:
        raise ValueError("an empty taxonomy")
    return roots
