"""Linking the spellings of names that people typed: organisations and persons.

Method: *MinHash banding over padded q-grams*, with bands and rows from the collision curve for the recall wanted, proposes pairs
of name parts; *Monge-Elkan similarity* over their words, so that the order and the spacing of words do not matter, verifies
them; *star clustering* gathers them around the spelling most used, so that chains of typing errors do not run on.

Which word of a name is the name proper, the *core* (of an organisation its own name, of a person the family name), and which
is the *qualifier* (the trade, the given name) is told by the corpus: a qualifier stands beside many different words, a core
beside few.  Where the corpus says nothing, usage does (``core trade``, ``given family``, ``family, given``).  There is no list
of trades or given names.  Qualifiers that the corpus uses with very many names are also what short forms are read by:
``Mfg.``, ``Pharma`` by their letters, familiar forms of given names by a list of general knowledge (``data/nicknames.txt``,
a parameter).

Accounts of one core and one qualifier name one entity; spellings without a full qualifier (none, only an initial, a form of
several names, a core cut short) go to the one entity they can mean, told apart by what else is known of the account (legal
form, the other name on it), and to none where that stays open.

Scale: all stages work on distinct spellings and words with counts; a spelling of a third of all rows is one row here.  Within
a bucket members are compared with its most used one, and only what then still stands alone is compared in pairs, so the many
misspellings of one frequent name cost a row each.  Groups are never collected: stars are found by joins in rounds until none
is left, entities by aggregation.

Defined cases: null, empty and placeholder names and names of departments have no entity, nor has a given name alone; rows
repeated whole count once; a name of which nothing is known but its core is an entity by that core; a name of any length is
read, cores of one letter included.
"""

from __future__ import annotations

import math
import os
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semframe.session import durable, release

# --- fixed values ------------------------------------------------------------------------------------------------------
PLACEHOLDERS = set("|-|--|n/a|na|none|null|nil|tbd|tba|unknown|unbekannt|test|test account|x|xx|xxx|?|.|not available|no name|anonymous|dummy".split("|"))
# words of which the names of departments and functions are made, and those of which one is enough
DEPARTMENT = set(
    "desk helpdesk team dept department payable receivable accounts office support sales reception purchasing procurement service services"
    " admin administration hr info billing finance accounting marketing legal operations it staff switchboard secretary customer care front".split()
)
DEPARTMENT_SURE = set("desk helpdesk team dept department payable receivable purchasing procurement reception switchboard accounting".split())
TITLES = set("mr mrs ms miss mx dr prof professor ing dipl sir dame herr frau attn attention sr sra mme mlle rev hon phd msc mba jr md".split())
LEGAL = {
    "limited": "ltd", "ltd": "ltd", "llc": "llc", "inc": "inc", "incorporated": "inc", "corp": "corp", "corporation": "corp", "co": "co", "company": "co",
    "gmbh": "gmbh", "ag": "ag", "ab": "ab", "sa": "sa", "sarl": "sarl", "bv": "bv", "nv": "nv", "pty": "pty", "plc": "plc", "oy": "oy", "as": "as",
    "srl": "srl", "spa": "spa", "kg": "kg", "llp": "llp", "lp": "lp", "kk": "kk", "sas": "sas",
}
FILLERS = {"the", "and", "of", "branch", "und", "et", "y"}
NICKNAMES = os.path.join(os.path.dirname(os.path.abspath(__file__)), "data", "nicknames.txt")

#: q of the padded q-grams; similarity at which a pair must collide, and how surely.
Q, RECALL_AT, RECALL = 3, 0.45, 0.96
#: Words up to this length are below the curve after one error (a swap in six letters leaves a quarter of the q-grams), so
#: they also collide by what is left when one letter is taken out, which finds every single error.
SHORT = 12
#: Monge-Elkan similarity from which two names are spellings of one.
SIMILAR = 0.8
#: A word is a qualifier of the corpus from so many different neighbours on, and from the root of the most that any word has.
LEAST_NEIGHBOURS = 8
#: A word with this share of another's neighbours is a word of its own, not a misspelling of it.
OWN_WORD = 0.1


# --- similarity --------------------------------------------------------------------------------------------------------
def edits(a: str, b: str, most: int) -> int:
    """Optimal string alignment distance (insert, delete, replace, swap neighbours), or ``most + 1``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return len(a) + len(b)
    beyond = most + 1
    two: list[int] = []
    one = [min(j, beyond) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        # only the band within ``most`` of the diagonal can hold a distance that counts
        lo, hi = max(1, i - most), min(len(b), i + most)
        row = [beyond] * (len(b) + 1)
        row[0] = min(i, beyond)
        least = row[0]
        for j in range(lo, hi + 1):
            y = b[j - 1]
            v = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, two[j - 2] + 1)
            row[j] = v
            if v < least:
                least = v
        if least > most:
            return beyond
        two, one = one, row
    return min(one[-1], beyond)


def edit_similarity(a: str, b: str) -> float:
    """One less the share of edits; 0 from a quarter of the letters on.  Long texts are tried with few edits first, so that their
    cost goes with what differs."""
    n = max(len(a), len(b))
    most = n // 4 + 1
    k = most if n <= 64 else 4
    while (d := edits(a, b, k)) > k:
        if k == most:
            return 0.0
        k = min(most, 4 * k)
    return 1 - d / n if n else 0.0


def monge_elkan(a: list[str], b: list[str], similarity: Callable[[str, str], float] = edit_similarity) -> float:
    """Mean over the words of one name of their best match in the other, each word weighing its letters; the smaller of both
    directions."""
    if not a or not b:
        return 0.0
    def toward(a: list[str], b: list[str]) -> float:
        there = set(b)
        return sum(len(x) * (1.0 if x in there else max(similarity(x, y) for y in b)) for x in a) / sum(map(len, a))

    return min(toward(a, b), toward(b, a))


def _written_in_one(x: list[str], y: list[str]) -> tuple[str, str] | None:
    """Two names each in one word, where they may be compared so: a whole word more or less is another name."""
    one, two = "".join(x), "".join(y)
    return None if len(x) == len(y) == 1 or abs(len(one) - len(two)) >= min(map(len, x + y)) else (one, two)


def same_name(a: str, b: str, similarity: Callable[[str, str], float] = edit_similarity) -> float:
    """Monge-Elkan similarity of two names of words between blanks, or, if that is more, of the names written in one word."""
    x, y = a.split(" "), b.split(" ")
    words = monge_elkan(x, y, similarity)
    if words >= SIMILAR or (glued := _written_in_one(x, y)) is None:
        return words
    return max(words, monge_elkan(glued[:1], glued[1:], similarity))


# --- reading a spelling ------------------------------------------------------------------------------------------------
_LEET = str.maketrans("01345", "oieas")
_TRAIL = re.compile(r"\s*(?:\(([^)]*)\)|\[([^\]]*)\]|\s[-–—/|]\s(.*)|\bext\.?\s*\d+)\s*$", re.I)


def _plain(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def _tokens(s: str) -> list[tuple[str, bool, str]]:
    """``(lower word, ends in a full stop, as typed)``; capitals within a word begin a new one, hyphens do not."""
    s = re.sub(r"(?<=[a-z]{2})(?=[A-Z][a-z])", " ", s)
    s = re.sub(r"['’`]", "", s)
    s = re.sub(r"(?<=\w)[-‐](?=\w)", "", s)
    out = []
    for m in re.finditer(r"[^\W_]+", s):
        t = m.group()
        if any(c.isdigit() for c in t) and sum(c.isalpha() for c in t) > 1:
            t = t.translate(_LEET)
        out.append((t.lower(), s[m.end() : m.end() + 1] == ".", t))
    return out


def _cut_trails(s: str) -> tuple[str, list[str]]:
    """A name without remarks at its end (in brackets, after a dash or slash), and their words."""
    s, said = " ".join(s.split()), []
    while (m := _TRAIL.search(s)) and m.start() > 0:
        said += [t for t, _, _ in _tokens(" ".join(x for x in m.groups() if x))]
        s = s[: m.start()]
    return s, said


def read_organisation(raw: str | None) -> dict | None:
    """``words`` (each with whether it ends in a full stop), ``family`` (1 if the first word is turned round with a comma, else -1),
    ``side`` (its legal form), ``remarks``; None for a placeholder."""
    if raw is None or _plain(raw).strip().lower() in PLACEHOLDERS:
        return None
    s, remarks = _cut_trails(_plain(raw))
    s = re.sub(r"\b((?:\w\.\s?){2,4})(?=\W|$)", lambda m: m[1].replace(".", "").replace(" ", "") + " ", s)  # G.m.b.H., S. A.
    s = re.sub(r"\b(\w(?: \w){1,3})\b", lambda m: m[1].replace(" ", ""), s)  # S A
    words, side, toks = [], "", _tokens(s)
    if len(toks) > 2 and toks[-1][0] == "branch":  # the word before is a place; if three are left, the last may belong to it
        remarks.append(toks[-2][0])
        toks = toks[:-2]
        if len(toks) > 2:
            remarks.append(toks[-1][0])
    for t, stop, _ in toks:
        if t in LEGAL and words:
            side = side or LEGAL[t]
        elif t not in FILLERS:
            words.append((t, stop))
    # turned round: one word, a comma, the name
    before = [t for t, _, _ in _tokens(s.split(",", 1)[0])] if "," in s else []
    turned = len(before) == 1 and len(words) > 1
    return {"words": words, "family": 1 if turned else -1, "initial": "", "side": side, "remarks": remarks} if words else None


def read_person(raw: str | None) -> dict | None:
    """``words``, ``family`` (which of them is marked as the family name, else -1), ``initial`` of the given name if there is
    only that, ``remarks``; None for a placeholder or department."""
    if raw is None or _plain(raw).strip().lower() in PLACEHOLDERS:
        return None
    s, remarks = _cut_trails(_plain(raw))
    if re.search(r"\b[a-z][A-Z]{2,}", s):
        s = s.swapcase()
    comma = bool(re.match(r"^[^,]*\w[^,]*,\s*\S", s))
    toks = [x for x in _tokens(s.replace(",", " ")) if x[0] not in TITLES]
    if len(toks) == 1 and re.match(r"[A-Z][A-Z][a-z]", toks[0][2]):  # no space between an initial and the family name
        t, stop, typed = toks[0]
        toks = [(t[0], False, typed[0]), (t[1:], stop, typed[1:])]
    if all(t in DEPARTMENT for t, _, _ in toks) or any(t in DEPARTMENT_SURE for t, _, _ in toks):
        return None
    long = [x for x in toks if len(x[0]) > 1]
    if not long:
        return None
    initials = [t for t, _, _ in toks if len(t) == 1]
    upper = [x[2].isupper() for x in long]
    family = -1
    if len(long) > 1:
        family = 0 if comma else upper.index(True) if sum(upper) == 1 else -1
    return {"words": [(t, stop) for t, stop, _ in long], "family": family, "initial": initials[0] if initials and len(long) == 1 else "", "side": "", "remarks": remarks}


READERS = {"acct_nm": read_organisation, "prim_cntct": read_person}
ORGANISATION = "acct_nm"
_READ = "field string, raw string, n bigint, words array<struct<t:string,stop:boolean>>, family int, initial string, side string, remarks array<string>"


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for field, raw, n in zip(batch["field"], batch["raw"], batch["n"]):
            if r := READERS[field](raw):
                rows.append((field, raw, n, [{"t": t, "stop": s} for t, s in r["words"]], r["family"], r["initial"], r["side"], r["remarks"]))
        yield pd.DataFrame(rows, columns=["field", "raw", "n", "words", "family", "initial", "side", "remarks"])


def _spread(df: DataFrame) -> DataFrame:
    """Rows over all cores before costly Python work: few bytes would otherwise be few tasks."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


# --- MinHash banding ---------------------------------------------------------------------------------------------------
def bands_for(similarity: float = RECALL_AT, recall: float = RECALL, chance: float = 0.08) -> tuple[int, int]:
    """``(bands, rows)`` with ``1 - (1 - s**rows)**bands >= recall`` at ``s = similarity``, that let the fewest chance pairs
    (at similarity ``chance``) collide for the hashing they cost."""
    best = None
    for rows in range(2, 7):
        p = similarity**rows
        bands = math.ceil(math.log(1 - recall) / math.log(1 - p))
        if bands * rows > 400:
            continue
        cost = (1 - (1 - chance**rows) ** bands) * 1e5 + bands
        if best is None or cost < best[0]:
            best = (cost, bands, rows)
    return best[1], best[2]


def grams(name: str, q: int = Q) -> set[str]:
    """The padded q-grams of the words of a name, in any order of the words."""
    out: set[str] = set()
    for word in name.split(" "):
        padded = "^" * (q - 1) + word + "$" * (q - 1)
        out.update(padded[i : i + q] for i in range(len(padded) - q + 1))
    return out


def _hash(s: str) -> int:
    h = 0xCBF29CE484222325
    for b in s.encode():
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return h


def deletions(name: str) -> set[str]:
    """A short name written in one word, and that with each letter taken out; none of a longer one."""
    word = name.replace(" ", "")
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))} if len(word) <= SHORT else set()


def _mixed(grams: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The value of each hash function for each q-gram."""
    v = grams[:, None] * mul + add
    v ^= v >> np.uint64(29)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    return v ^ (v >> np.uint64(32))


def _least_hashes(grams: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The least value of each hash function, over a few thousand q-grams at a time."""
    least = np.full(len(mul), np.uint64(0xFFFFFFFFFFFFFFFF))
    for lo in range(0, len(grams), 4096):
        least = np.minimum(least, _mixed(grams[lo : lo + 4096], mul, add).min(axis=0))
    return least


#: Names of up to so many q-grams are hashed together, by values that are kept for so many q-grams.
USUAL_GRAMS, KEPT_GRAMS = 48, 16_384


def _banded(bands: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(20250101)
        mul = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        add = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
        place: dict[str, int] = {}
        values = np.empty((0, bands * rows), dtype=np.uint64)

        def signatures(names: list[set[str]]) -> np.ndarray:
            nonlocal values
            fresh = list(dict.fromkeys(x for g in names for x in g if x not in place))
            if fresh and len(place) + len(fresh) > KEPT_GRAMS:
                place.clear()
                values, fresh = values[:0], list(dict.fromkeys(x for g in names for x in g))
            if fresh:
                place.update(zip(fresh, range(len(place), len(place) + len(fresh))))
                values = np.concatenate([values, _mixed(np.array([_hash(x) for x in fresh], dtype=np.uint64), mul, add)])
            most = max(map(len, names))
            at = np.array([(p := [place[x] for x in g]) + p[:1] * (most - len(p)) for g in names])
            least = values[at[:, 0]]
            for j in range(1, most):
                np.minimum(least, values[at[:, j]], out=least)
            return least

        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.iloc[lo : lo + 500]
                every = [grams(name) for name in part["name"]]
                sig = np.empty((len(part), bands * rows), dtype=np.uint64)
                usual = [i for i, g in enumerate(every) if len(g) <= USUAL_GRAMS]
                if usual:
                    sig[usual] = signatures([every[i] for i in usual])
                for i, g in enumerate(every):
                    if len(g) > USUAL_GRAMS:
                        sig[i] = _least_hashes(np.array([_hash(x) for x in g], dtype=np.uint64), mul, add)
                sig = sig.reshape(len(part), bands, rows)
                keys = np.zeros((len(part), bands), dtype=np.uint64)
                for r in range(rows):
                    keys = (keys ^ sig[:, :, r]) * np.uint64(0x9E3779B97F4A7C15)
                    keys ^= keys >> np.uint64(31)
                keys += np.arange(bands, dtype=np.uint64)
                extra = [(i, x) for i, name in enumerate(part["name"]) for x in deletions(name)]
                at = np.concatenate([np.repeat(np.arange(len(part)), bands), np.array([i for i, _ in extra], dtype=np.int64)])
                bucket = np.concatenate([keys.reshape(-1), pd.util.hash_array(np.array([x for _, x in extra], dtype=object), categorize=False)])
                if "field" in part:  # a bucket holds names of one field
                    bucket ^= pd.util.hash_array(part["field"].to_numpy(dtype=object))[at]
                yield pd.DataFrame({"id": part["id"].to_numpy()[at], "bucket": bucket.view(np.int64)})

    return run


#: Words up to this length are compared many at a time.
USUAL_WORD = 40


def edits_of_words(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """``edits`` of many pairs of words of up to ``USUAL_WORD`` letters; any number over ``most`` where there are more."""
    la, lb = (np.array([len(x) for x in w], dtype=np.int64) for w in (a, b))
    x, y = (np.ascontiguousarray(np.array(w, dtype=f"U{USUAL_WORD}").view(np.uint32).reshape(len(w), -1).T) for w in (a, b))
    far, wide = np.int8(most + 1), int(lb.max(initial=0))
    out = np.where(la == 0, lb, 0).astype(np.int8)
    beyond = np.full(len(a), far)
    two: list[np.ndarray] = []
    one = [np.full(len(a), min(j, most + 1), dtype=np.int8) for j in range(wide + 1)]
    for i in range(1, int(la.max(initial=0)) + 1):
        row = [beyond] * (wide + 1)
        row[0] = np.full(len(a), min(i, most + 1), dtype=np.int8)
        for j in range(max(1, i - most), min(wide, i + most) + 1):
            v = np.minimum(np.minimum(one[j], row[j - 1]) + np.int8(1), one[j - 1] + (x[i - 1] != y[j - 1]))
            if i > 1 and j > 1:
                swapped = (x[i - 1] == y[j - 2]) & (x[i - 2] == y[j - 1])
                v = np.where(swapped, np.minimum(v, two[j - 2] + np.int8(1)), v)
            row[j] = np.minimum(v, far)
        for j in np.unique(lb[la == i]):
            ends = (la == i) & (lb == j)
            out[ends] = row[j][ends]
        two, one = one, row
    return out


def edit_similarities(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``edit_similarity`` of many pairs of words of up to ``USUAL_WORD`` letters."""
    n = np.array([max(len(x), len(y)) for x, y in zip(a, b)], dtype=np.int64)
    out = np.zeros(len(n))
    for quarter in np.unique(n // 4):  # of about one length, so that the band is as narrow as it can be
        k = np.flatnonzero((n // 4 == quarter) & (n > 0))
        d = edits_of_words(a[k], b[k], int(quarter) + 1)
        out[k] = np.where(d > quarter + 1, 0.0, 1 - d / n[k])
    return out


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        # all comparisons of words that the names need, at once
        needed: dict[tuple[str, str], float] = {}
        for a, b in zip(batch["na"], batch["nb"]):
            x, y = a.split(" "), b.split(" ")
            for p in x:
                for q in y:
                    needed[p, q] = 0.0
            if glued := _written_in_one(x, y):
                needed[glued] = 0.0
        words = [p for p in needed if len(p[0]) <= USUAL_WORD and len(p[1]) <= USUAL_WORD]
        known = dict(zip(words, edit_similarities(*np.array(words, dtype=object).reshape(-1, 2).T).tolist()))

        def similarity(p: str, q: str, known=known) -> float:
            found = known.get((p, q))
            if found is None:
                found = known.get((q, p))
            return edit_similarity(p, q) if found is None else found

        sim = np.array([same_name(a, b, similarity) for a, b in zip(batch["na"], batch["nb"])], dtype=float)
        batch = batch[["field", "a", "b"]].assign(sim=sim)
        yield batch[batch["sim"] >= SIMILAR]


def letters(name: str) -> int:
    """The letters of a name as a set of bits, and from bit 32 on those that it has twice; letters may share a bit."""
    m = 0
    for c in name.replace(" ", ""):
        bit = 1 << (ord(c) & 31)
        m |= bit << 32 if m & bit else bit
    return m - (1 << 64) if m >> 63 else m


def _lettered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(mask=[letters(x) for x in batch["name"]])


def _may_be_similar(a: str, b: str) -> Column:
    """What names of columns ``len, mask, one, div`` after these prefixes must have in common to be similar.  Lengths too different,
    and two words that both stand beside many others, need no comparison; an edit takes away one letter at most, and a word whose
    best match is longer loses no more than its share.  In names of several words one word may match more than one, so there
    only letters that are missing altogether count."""
    col = lambda p, c: F.col(p + c)
    n = F.greatest(col(a, "len"), col(b, "len"))
    near = F.abs(col(a, "len") - col(b, "len")) <= n * (1 - SIMILAR) + 1
    own = (F.least(col(a, "div"), col(b, "div")) >= LEAST_NEIGHBOURS) & (F.least(col(a, "div"), col(b, "div")) >= F.greatest(col(a, "div"), col(b, "div")) * OWN_WORD)
    words = col(a, "one") & col(b, "one")
    counted = F.when(words, F.lit(-1).cast("bigint")).otherwise(F.lit(0xFFFFFFFF))
    most = n * (1 - SIMILAR) + 0.01
    gone = lambda p, q: F.bit_count(col(p, "mask").bitwiseAND(F.bitwise_not(col(q, "mask"))).bitwiseAND(counted)) <= most
    return near & ~own & gone(a, b) & gone(b, a)


_EDGE = "field string, a bigint, b bigint, sim double"


def _compared(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``field, a, b, sim`` of the candidate ids that spell one name."""
    cols = ("name", "field", "len", "mask", "one", "div")
    side = lambda p: nodes.select(F.col("id").alias(p), *[F.col(c).alias(p + c) for c in cols])
    both = pairs.join(side("a"), "a").join(side("b"), "b").where((F.col("afield") == F.col("bfield")) & _may_be_similar("a", "b"))
    return _spread(both.select(F.col("afield").alias("field"), "a", "b", F.col("aname").alias("na"), F.col("bname").alias("nb"))).mapInPandas(_verified, _EDGE)


def cluster(nodes: DataFrame) -> DataFrame:
    """``field, name, center``: ``nodes`` of ``_numbered`` by star clustering of the pairs that collide and are similar.

    First each node is compared with the most used node of each of its buckets; what finds its centre there is done.  The others
    are then compared in all pairs of their buckets, so no pair that collides is lost, while the many spellings of a frequent
    name never meet each other.  Names that share a part collide by chance the more the larger the corpus is, so of a bucket's
    pairs only those go on whose letters may be similar.
    """
    bands, rows = bands_for()
    banded = _spread(nodes.select("id", "field", "name")).mapInPandas(_banded(bands, rows), "id bigint, bucket bigint")
    w = Window.partitionBy("bucket")
    shared = durable(banded.withColumn("members", F.count(F.lit(1)).over(w)).withColumn("top", F.max("id").over(w)).where("members > 1").select("id", "bucket", "top"))
    first = durable(_compared(shared.where("id <> top").select(F.col("id").alias("a"), F.col("top").alias("b")).distinct(), nodes))
    near = durable(stars(nodes, first))
    alone = near.where("id = center").select("id")
    cols = ("id", "len", "mask", "one", "div")
    left = shared.select("id", "bucket").join(nodes.join(alone, "id", "left_semi").select(*cols), "id")
    side = lambda p: left.select("bucket", *[F.col(c).alias(p + c) for c in cols])
    pairs = side("a").join(side("b"), "bucket").where((F.col("aid") < F.col("bid")) & _may_be_similar("a", "b")).select(F.col("aid").alias("a"), F.col("bid").alias("b")).distinct()
    found = durable(_compared(pairs, nodes))
    release(shared)
    far = stars(nodes.join(alone, "id", "left_semi"), found)
    label = nodes.select(F.col("id").alias("last"), F.col("name").alias("center"))
    return (
        near.withColumnRenamed("center", "mid").join(far.select(F.col("id").alias("mid"), F.col("center").alias("last")), "mid")
        .join(label, "last").join(nodes.select("id", "field", "name"), "id").select("field", "name", "center")
    )


def stars(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, center``: star clustering.  A node heavier than all its free neighbours, which is one of a larger id, becomes a centre
    and takes them; this repeats among the nodes still free until no edge is left (the heaviest free node always is a centre,
    so it ends)."""
    free = durable(edges.select("a", "b", "sim").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")))
    parts: list[DataFrame] = []
    while not free.isEmpty():
        tops = free.groupBy("a").agg(F.max("b").alias("top")).where("a > top").select(F.col("a").alias("center"))
        joined = (
            free.join(tops.withColumnRenamed("center", "a"), "a").groupBy("b").agg(F.max(F.struct("sim", "a")).alias("m"))
            .select(F.col("b").alias("id"), F.col("m.a").alias("center"))
        )
        new = durable(joined.unionByName(tops.select(F.col("center").alias("id"), "center")))
        parts.append(new)
        gone = new.select("id")
        last = free
        free = durable(free.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti"))
        release(last)
        if len(parts) == 8:  # the plan stays as deep as it is
            parts = [durable(_union(parts))]
    release(free)
    own = nodes.select("id")
    if not parts:
        return own.withColumn("center", F.col("id"))
    return own.join(_union(parts), "id", "left").withColumn("center", F.coalesce("center", "id"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --- words and their parts in names ------------------------------------------------------------------------------------
def _fits_short(q: str, g: str) -> int:
    """How a word may write a longer one in short: 1 by its beginning, 2 by letters left out (vowels first), 3 by a beginning
    with a typing error; 0 not at all."""
    if len(q) < 2 or len(q) >= len(g) or q[0] != g[0]:
        return 0
    if g.startswith(q):
        return 1
    if len(q) <= 0.8 * len(g) and sum(c in "aeiou" for c in q) <= 1 + len(q) // 5:
        at = iter(g)
        if all(c in at for c in q):
            return 2
    if len(q) >= 5 and q[:2] == g[:2] and edits(q, g[: len(q)], 1) <= 1:
        return 3
    return 0


def _reading(field: str, q: str, g: str, dq: int, dg: int) -> int:
    """How ``q`` may stand for the more usual ``g``, the surest way least: short forms of trades, beginnings of given names, and
    words too short to be similar after one error."""
    if field == ORGANISATION and (how := _fits_short(q, g)):
        return how
    if field != ORGANISATION and len(q) >= 3 and g.startswith(q) and 2 * dq <= dg:
        return 1
    return 4 if len(q) >= 3 and len(g) >= 4 and dq <= max(1, OWN_WORD * dg) and edits(q, g, 1) <= 1 else 0


def _shorts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        how = [_reading(*x) for x in zip(batch["field"], batch["q"], batch["g"], batch["dq"], batch["dg"])]
        batch = batch[["field", "q", "g", "gen"]].assign(how=how)
        yield batch[batch["how"] > 0]


def nickname_pairs(path: str = NICKNAMES) -> list[tuple[str, str]]:
    """``(short form, given name)`` of a list ``given name: short forms``, folded like the names."""
    out = []
    with open(path, encoding="utf-8") as f:
        for line in f:
            if line.strip() and not line.startswith("#"):
                formal, _, shorts = line.partition(":")
                out += [(_plain(x).lower(), _plain(formal).strip().lower()) for x in shorts.split()]
    return out


def _least(words: DataFrame, div: str) -> Column:
    """From how many neighbours on a word of the field is a qualifier of the corpus."""
    tops = {r["field"]: r["m"] for r in words.groupBy("field").agg(F.max(div).alias("m")).collect()}  # one number a field
    out = F.lit(LEAST_NEIGHBOURS)
    for field, top in tops.items():
        out = F.when(F.col("field") == field, max(LEAST_NEIGHBOURS, math.ceil(math.sqrt(top)))).otherwise(out)
    return out


def _word_table(read: DataFrame) -> DataFrame:
    """``field, t, n, plain, stops, rem, qual, votes, div``: each word with the accounts that use it, how many spellings do so without
    and with a full stop, how many remarks hold it, beside how many different words it stands, and how often usage makes it a qualifier less how
    often a core."""
    at = F.posexplode("words").alias("pos", "w")
    # without marks: the last word of an organisation and the first of a person is the qualifier; marked family names count more
    k, pos = F.size("words"), F.col("pos")
    marked = F.when(F.col("family") >= 0, F.when(pos == F.col("family"), -2).otherwise(2))
    person = F.coalesce(marked, F.when(k == 1, F.when(F.col("initial") != "", -2).otherwise(0)).when(pos == 0, 1).when(pos == k - 1, -1).otherwise(0))
    firm = F.when(k == 1, 0).when(pos == 0, -1).when(pos == k - 1, 1).otherwise(0)
    vote = F.when(F.col("field") == ORGANISATION, F.coalesce(marked, firm)).otherwise(person)
    long = read.select("field", "n", "words", "family", "initial", at).select("field", F.col("w.t").alias("t"), "n", (~F.col("w.stop")).cast("int").alias("plain"), F.col("w.stop").cast("int").alias("stops"), F.lit(0).alias("rem"), vote.alias("qual"))
    remarks = read.select("field", F.explode("remarks").alias("t")).select("field", "t", F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("plain"), F.lit(0).alias("stops"), F.lit(1).alias("rem"), F.lit(0).alias("qual"))
    words = long.unionByName(remarks).groupBy("field", "t").agg(*[F.sum(c).alias(c) for c in ("n", "plain", "stops", "rem", "qual")], F.sum(F.abs("qual")).alias("votes"))
    pairs = read.where(F.size("words") > 1).select("field", F.explode(F.arrays_zip(F.expr("slice(words, 1, size(words) - 1).t").alias("a"), F.expr("slice(words, 2, size(words) - 1).t").alias("b"))).alias("p"))
    beside = pairs.select("field", F.col("p.a").alias("t"), F.col("p.b").alias("o")).unionByName(pairs.select("field", F.col("p.b").alias("t"), F.col("p.a").alias("o")))
    div = beside.groupBy("field", "t").agg(F.countDistinct("o").alias("div"))
    return words.join(div, ["field", "t"], "left").withColumn("div", F.coalesce("div", F.lit(0)))


def _unglued(read: DataFrame, words: DataFrame, least: Column) -> DataFrame:
    """``read`` with names written in one word taken apart where one part is a qualifier of the corpus: the end of an
    organisation's, the beginning of a person's."""
    whole = read.where((F.size("words") == 1) & (F.col("initial") == "")).select("field", F.col("words")[0]["t"].alias("t")).distinct().where(F.length("t") >= 7)
    cuts = whole.withColumn("i", F.explode(F.sequence(F.lit(3), F.length("t") - 3)))
    head, tail = F.expr("substring(t, 1, i)"), F.expr("substring(t, i + 1)")
    firm = F.col("field") == ORGANISATION
    cuts = cuts.select("field", "t", F.when(firm, tail).otherwise(head).alias("qualifier"), F.when(firm, head).otherwise(tail).alias("core"))
    known = words.where(F.col("div") >= least).select("field", F.col("t").alias("qualifier"))
    parts = cuts.join(known, ["field", "qualifier"]).groupBy("field", "t").agg(F.max(F.struct(F.length("qualifier").alias("l"), "qualifier", "core")).alias("m"))
    parts = parts.select("field", F.col("t").alias("_t"), "m.qualifier", "m.core")
    one, more = read.where(F.size("words") == 1), read.where(F.size("words") > 1)
    word = lambda c: F.struct(F.col(c).alias("t"), F.lit(False).alias("stop"))
    apart = F.when(F.col("qualifier").isNull() | (F.col("initial") != ""), F.col("words")).when(F.col("field") == ORGANISATION, F.array(word("core"), word("qualifier"))).otherwise(F.array(word("qualifier"), word("core")))
    split = one.withColumn("_t", F.col("words")[0]["t"]).join(parts, ["field", "_t"], "left").withColumn("words", apart).select(*read.columns)
    return more.unionByName(split)


def _informed(read: DataFrame, words: DataFrame, cols: list[str]) -> DataFrame:
    """Per spelling its words with ``cols`` of the word table, in order."""
    at = read.select("field", "raw", F.posexplode("words").alias("pos", "w")).select("field", "raw", "pos", F.col("w.t").alias("t"), F.col("w.stop").alias("stop"))
    full = at.join(words.select("field", "t", *cols), ["field", "t"])
    back = full.groupBy("field", "raw").agg(F.sort_array(F.collect_list(F.struct("pos", "t", "stop", *cols))).alias("ws"))
    return read.drop("words").join(back, ["field", "raw"])


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Names of several words that may be a core: the words of a spelling that are no qualifiers, all, and without the first or
    the last of them."""
    for batch in batches:
        rows = []
        for field, n, ws in zip(batch["field"], batch["n"], batch["ws"]):
            own = [w["t"] for w in ws if not w["gen"]]
            for part in {tuple(own), tuple(own[1:]), tuple(own[:-1])}:
                if len(part) > 1:
                    rows.append((field, " ".join(part), n))
        yield pd.DataFrame(rows, columns=["field", "name", "n"])


def _whole_name() -> Column:
    """The words of a spelling of which none is a qualifier, as the name of a group; else null."""
    return F.when((F.size("ws") > 1) & ~F.exists("ws", lambda w: w["gen"]), F.array_join(F.transform("ws", lambda w: w["t"]), " "))


_ROLES = "field string, raw string, written string, core string, cut boolean, q string, initial string, side string"


def _roles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Core and qualifier of each spelling."""
    for batch in batches:
        rows = []
        for field, raw, family, initial, side, ws, one in zip(*[batch[c] for c in ("field", "raw", "family", "initial", "side", "ws", "one")]):
            if one is not None:  # all words together are a known name of one word
                rows.append((field, raw, "", one, False, "", "", side))
                continue
            marked = ws[family]["t"] if 0 <= family < len(ws) else None
            kept = [w for w in ws if not w["remark"]] or list(ws)
            q = None
            if len(kept) > 1:
                free = [w for w in kept if w["t"] != marked or w["gen"] and not all(x["gen"] for x in kept)] or kept
                q = min(free, key=lambda w: (-w["score"], w["c"]))
                kept = [w for w in kept if w is not q]
                kept = [w for w in kept if not w["gen"]] or kept
            elif field != ORGANISATION and not initial and kept[0]["gen"]:
                continue  # a given name alone
            alone = len(kept) == 1
            core = kept[0]["c"] if alone else " ".join(w["t"] for w in kept)
            cut = alone and bool(kept[0]["stop"]) and not kept[0]["plain"] and kept[0]["c"] == kept[0]["t"]
            written = " ".join(w["t"] for w in ws)
            rows.append((field, raw, written, core, cut, q["c"] if q is not None else "", initial if q is None else "", side))
        yield pd.DataFrame(rows, columns=["field", "raw", "written", "core", "cut", "q", "initial", "side"])


def _numbered(nodes: DataFrame) -> DataFrame:
    """``nodes(field, name, weight, div)`` with ids in the order of their weights, and what is to be known of a name before it is compared."""
    x = nodes.select("field", "name", "weight", F.col("div").cast("bigint").alias("div")).orderBy("weight", "name", "field")
    x = x.mapInPandas(_lettered, "field string, name string, weight bigint, div bigint, mask bigint")
    return durable(x.select("*", F.length("name").alias("len"), (F.instr("name", " ") == 0).alias("one"), F.monotonically_increasing_id().alias("id")))


def spellings(accounts: DataFrame, nicknames: str = NICKNAMES) -> DataFrame:
    """``field, raw, center, cut, options, initial, side`` of the distinct ``accounts(field, raw, n)``: the core that a spelling has,
    whether it is cut short, the qualifiers it may mean, and what else it says."""
    spark = accounts.sparkSession
    read = durable(_spread(accounts).mapInPandas(_read, _READ))
    raw_words = durable(_word_table(read))
    least = _least(raw_words, "div")
    read = durable(_unglued(read, raw_words, least))
    words = durable(_word_table(read))
    flags = words.withColumn("gen", F.col("div") >= least)
    single = flags.select("field", F.col("t").alias("name"), F.col("n").alias("weight"), "div")
    groups = _informed(read, flags, ["gen"]).where(F.size(F.filter("ws", lambda w: ~w["gen"])) > 1).select("field", "n", "ws").mapInPandas(_groups, "field string, name string, n bigint")
    groups = groups.groupBy("field", "name").agg(F.sum("n").alias("weight")).withColumn("div", F.lit(0).cast("bigint"))
    center = durable(cluster(_numbered(single.where("weight > 0").unionByName(groups))))

    # what is known of a word is known of all its misspellings
    named = words.join(center.select("field", F.col("name").alias("t"), F.col("center").alias("c")), ["field", "t"])
    sums = named.groupBy("field", "c").agg(F.max("div").alias("cdiv"), F.sum("qual").alias("cqual"), F.sum("votes").alias("cvotes"))
    score = F.log1p("cdiv") + 4 * F.col("cqual") / (F.col("cvotes") + 2)
    known = durable(
        named.join(sums, ["field", "c"]).withColumn("score", score).withColumn("gen", F.col("cdiv") >= least)
        .withColumn("remark", (F.col("rem") > 0) & (F.col("rem") >= F.col("plain") + F.col("stops"))).withColumn("plain", 2 * F.col("plain") > F.col("stops"))
    )
    joined = center.where("name like '% %' and center not like '% %'").select("field", F.col("name").alias("whole"), F.col("center").alias("one"))
    informed = _informed(read, known, ["c", "score", "gen", "remark", "plain"]).withColumn("whole", _whole_name()).join(joined, ["field", "whole"], "left")
    roles = durable(_spread(informed).mapInPandas(_roles, _ROLES))
    roles = roles.join(center.select("field", F.col("name").alias("core"), "center"), ["field", "core"], "left").withColumn("center", F.coalesce("center", "core"))

    # a name of one word that is a spelling of one of several words has its core and qualifier
    read_so = roles.where("q <> ''").groupBy("field", F.col("written").alias("center")).agg(F.min(F.struct(F.col("center").alias("c"), "q")).alias("m"))
    roles = durable(
        roles.join(read_so.select("field", "center", F.col("m.c").alias("c2"), F.col("m.q").alias("q2")), ["field", "center"], "left")
        .withColumn("turn", (F.col("q") == "") & F.col("center").contains(" ") & F.col("c2").isNotNull())
        .withColumn("center", F.when(F.col("turn"), F.col("c2")).otherwise(F.col("center"))).withColumn("q", F.when(F.col("turn"), F.col("q2")).otherwise(F.col("q")))
        .select("field", "raw", "center", "cut", "q", "initial", "side")
    )

    # what a qualifier may stand for
    quals = roles.where("q <> ''").select("field", "q").distinct().join(known.where("t = c").select("field", F.col("t").alias("q"), F.col("cdiv").alias("dq")), ["field", "q"])
    full = known.where("t = c and cqual > 0 and (gen or cdiv > 1)").select("field", F.col("t").alias("g"), F.col("cdiv").alias("dg"), "gen")
    pairs = quals.withColumn("key", F.substring("q", 1, 1)).join(full.withColumn("key", F.substring("g", 1, 1)), ["field", "key"]).where((F.col("q") != F.col("g")) & (F.col("dq") <= F.col("dg")))
    # beside the same core any longer one may be meant
    own = roles.where("q <> '' and not cut").select("field", "center", "q").distinct().withColumn("key", F.substring("q", 1, 1))
    beside = own.join(own.withColumnRenamed("q", "g"), ["field", "center", "key"]).where(F.length("q") < F.length("g")).select("field", "q", "g").distinct()
    beside = beside.join(quals, ["field", "q"]).join(quals.select("field", F.col("q").alias("g"), F.col("dq").alias("dg")), ["field", "g"]).where(F.col("field") == ORGANISATION)
    pairs = pairs.select("field", "q", "g", "dq", "dg", "gen").unionByName(beside.select("field", "q", "g", "dq", "dg", F.lit(False).alias("gen"))).groupBy("field", "q", "g", "dq", "dg").agg(F.max("gen").alias("gen"))
    short = _spread(pairs.select("field", "q", "g", "dq", "dg", "gen")).mapInPandas(_shorts, "field string, q string, g string, gen boolean, how int")
    # what few names have is read so only where nothing that many have fits
    short = short.select("field", "q", "g", (F.col("how") + F.when(F.col("gen"), 1).otherwise(11)).alias("how"))
    listed = spark.createDataFrame(nickname_pairs(nicknames), "q string, g string").withColumn("field", F.lit("prim_cntct"))
    # a given name by what its misspellings are read as, where the corpus has it
    formal = listed.join(center.select("field", F.col("name").alias("g"), F.col("center").alias("gc")), ["field", "g"], "left")
    formal = formal.select("field", "q", F.coalesce("gc", "g").alias("g"), F.when(F.col("gc").isNull(), 1).otherwise(0).alias("how")).join(quals.select("field", "q"), ["field", "q"])
    # the best way to read it: listed and in use, listed, by its beginning, by its letters
    ways = formal.unionByName(short).where("q <> g")
    best = durable(ways.groupBy("field", "q").agg(F.min("how").alias("how")).join(ways, ["field", "q", "how"]).groupBy("field", "q").agg(F.collect_set("g").alias("gs")))
    # a short form of a short form means what that means
    deeper = best.select("field", "q", F.explode("gs").alias("g")).join(best.select("field", F.col("q").alias("g"), F.col("gs").alias("more")), ["field", "g"], "left")
    options = deeper.groupBy("field", "q").agg(F.array_distinct(F.flatten(F.collect_list(F.coalesce("more", F.array("g"))))).alias("options"))
    meant = F.when(F.col("q") == "", F.array().cast("array<string>")).otherwise(F.coalesce("options", F.array("q")))
    return roles.join(options, ["field", "q"], "left").select("field", "raw", "center", "cut", F.array_sort(meant).alias("options"), "initial", "side")


# --- entities ----------------------------------------------------------------------------------------------------------
def link(accounts: DataFrame, key: str = "cust_id", nicknames: str = NICKNAMES) -> DataFrame:
    """``field, key, entity``: for both fields, the entity that each account names; accounts without one are left out."""
    kind = dict(accounts.dtypes)[key]
    long = accounts.select(F.col(key).alias("key"), F.expr("stack(2, 'acct_nm', acct_nm, 'prim_cntct', prim_cntct) as (field, raw)")).where(F.col("key").isNotNull() & F.col("raw").isNotNull()).distinct()
    seen = spellings(long.groupBy("field", "raw").agg(F.count(F.lit(1)).alias("n")), nicknames)
    named = durable(long.join(seen, ["field", "raw"]))
    # what the other field of the account says
    other = named.select("key", F.when(F.col("field") == "acct_nm", "prim_cntct").otherwise("acct_nm").alias("field"), F.col("center").alias("context"))
    full = durable(
        named.join(other.groupBy("key", "field").agg(F.min("context").alias("context")), ["key", "field"], "left")
        .select("field", "key", "center", "cut", "options", "initial", "side", F.coalesce("context", F.lit("")).alias("context"))
    )
    definite = (F.size("options") == 1) & ~F.col("cut")
    sure = full.where(definite).withColumn("qual", F.element_at("options", 1))
    entities = sure.groupBy("field", "center", "qual").agg(F.count(F.lit(1)).alias("n"))
    contexts = sure.where("context <> ''").select("field", "center", "qual", "context").distinct()
    sides = (
        sure.where("side <> ''").groupBy("field", "center", "qual", "side").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("field", "center", "qual").agg(F.max(F.struct("n", "side")).alias("m")).select("field", "center", "qual", F.col("m.side").alias("usual"))
    )
    # what a spelling without a full qualifier may mean, by what it says alone: few patterns a core, however many accounts
    said = ["field", "center", "cut", "options", "initial"]
    text = F.concat_ws(",", "options")  # sorted
    vague = full.where(~definite).withColumn("pattern", F.concat_ws("\x1f", "center", F.col("cut").cast("string"), text, "initial"))
    patterns = vague.select("pattern", *said).distinct()
    # a core cut to less than three letters stands for too many names
    prefixes = (
        entities.withColumn("short", F.explode(F.expr("transform(filter(sequence(1, length(center)), n -> n >= 3), n -> substring(center, 1, n))")))
        .select("field", F.col("short").alias("center"), F.col("center").alias("whole"), "qual")
    )
    by_core = patterns.where("not cut").join(entities.select("field", "center", F.col("center").alias("whole"), "qual"), ["field", "center"])
    by_prefix = patterns.where("cut").join(prefixes, ["field", "center"])
    # beside a core cut short a qualifier is often cut too
    short = F.col("cut") & F.exists("options", lambda o: F.col("qual").startswith(o))
    fits = ((F.size("options") == 0) | F.array_contains("options", F.col("qual")) | short) & ((F.col("initial") == "") | F.col("qual").startswith(F.col("initial")))
    meant = durable(
        by_core.unionByName(by_prefix).where(fits).select("field", "pattern", "whole", "qual")
        .join(sides.withColumnRenamed("center", "whole"), ["field", "whole", "qual"], "left").withColumn("e", F.concat_ws("|", "whole", "qual"))
    )
    known = meant.join(contexts.withColumnRenamed("center", "whole"), ["field", "whole", "qual"])

    def counted(rows: DataFrame, by: list[str], n: str) -> DataFrame:
        return rows.groupBy("field", "pattern", *by).agg(F.when(F.count(F.lit(1)) == 1, F.min("e")).alias(f"e{n}"), F.lit(True).alias(f"has{n}"))

    # the narrowest evidence that fits anybody decides, if it fits just one: other name and legal form, other name, legal form, none
    sided = F.col("usual").isNotNull()
    steps = [
        (counted(known.where(sided), ["context", "usual"], "3").withColumnRenamed("usual", "side"), ["field", "pattern", "context", "side"]), (counted(known, ["context"], "2"), ["field", "pattern", "context"]),
        (counted(meant.where(sided), ["usual"], "1").withColumnRenamed("usual", "side"), ["field", "pattern", "side"]), (counted(meant, [], "0"), ["field", "pattern"]),
    ]
    settled = vague
    for table, on in steps:
        settled = settled.join(table, on, "left")
    choice = F.when(F.col("has3") & (F.col("context") != "") & (F.col("side") != ""), F.col("e3"))
    choice = choice.when(F.col("has2") & (F.col("context") != ""), F.col("e2")).when(F.col("has1") & (F.col("side") != ""), F.col("e1")).when(F.col("has0"), F.col("e0"))
    # nobody it could be: an entity by what it says; several it could be: none
    alone = F.concat_ws("|", "center", F.concat(F.lit("?"), F.coalesce(F.when(text != "", text), F.col("initial"))))
    settled = settled.withColumn("entity", F.when(F.col("has0"), choice).otherwise(alone)).where(F.col("entity").isNotNull()).select("field", "key", "entity")
    out = sure.select("field", "key", F.concat_ws("|", "center", "qual").alias("entity")).unionByName(settled)
    return out.select("field", F.col("key").cast(kind).alias(key), "entity").distinct()


def pairs(linked: DataFrame, key: str = "cust_id") -> DataFrame:
    """``field, key_a, key_b``: every two different accounts of an entity, the smaller key first."""
    a = linked.select("field", "entity", F.col(key).alias(f"{key}_a"))
    b = linked.select("field", "entity", F.col(key).alias(f"{key}_b"))
    return a.join(b, ["field", "entity"]).where(F.col(f"{key}_a") < F.col(f"{key}_b")).select("field", f"{key}_a", f"{key}_b").distinct()
