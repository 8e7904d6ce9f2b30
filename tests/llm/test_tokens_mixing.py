"""Tokens against an independent library; mixes against brute force."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from semframe.llm import mixing, tokens

VOCAB = os.path.join(tokens.VOCAB_DIR, "byte_bpe_50k.json")
pytestmark = pytest.mark.skipif(not os.path.exists(VOCAB), reason="no vocabulary files here")


def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCAB)
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_encoding_equals_library():
    rnd, bpe, want = random.Random(7), tokens.load(), reference()
    alphabet = ["e", "t", "a", "in", "ing", " ", "  ", "\n", "\t", "é", "中", "日", "ы", "🚀", "'s", "'", "1", "23", "--", "=", "　", "<|endoftext|>"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.choice([1, 7, 50]))) for _ in range(1500)]
    texts += ["".join(rnd.choice("abcdetionghrsu") for _ in range(rnd.randrange(2, 60))) for _ in range(1500)]
    texts += ["a" * 5000, "=" * 3000, "ab" * 4000, " " * 777]
    assert bpe.encode(texts) == [want(t) for t in texts]


def test_speculation_is_verified():
    bpe = tokens.load()
    words = [w.encode() for w in ("hello", "interdependencies", "zzzzqqq", "ationing", "unverified")]
    assert any(bpe.propose(w) != bpe.merge(w) for w in (bytes(random.Random(i).choices(b"abcdetionghrsu", k=14)) for i in range(200)))
    for w in words:
        bpe.learn([w.decode()])
        assert list(bpe.cache[w.decode()]) == bpe.merge(w)


def test_ids_of_empty_and_null(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "yes yes"), (3, "yes yes")], "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = tokens.encode_corpus(df).orderBy("doc_id").collect()
    assert [r["ids"] for r in got[:2]] == [[], []] and got[2]["ids"] == reference()("yes yes") == got[3]["ids"]
    assert tokens.encode_corpus(df.limit(0)).count() == 0


def test_mix_against_brute_force(spark):
    rnd = random.Random(3)
    rows = [(i, " ".join(["word"] * rnd.randrange(0, 60)), rnd.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    rows += [(1000, None, "a"), (1001, "", "b"), (1002, "long " * 900, "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("h", F.lit(0)).withColumn("n_tokens", F.lit(-1))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2), ("missing", 0.1, 2), ("zero", 0.0, 1)], "source string, target_share double, max_repeats int")
    sizes = mixing.sizes_of(docs)
    total = {r["source"]: r["t"] for r in sizes.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    uses = mixing.mix(sizes, targets)
    got = {r["key"]: r for r in uses.collect()}
    most = {"a": 1, "b": 3, "c": 2}
    assert len(got) == len(rows)
    assert all(r["uses"] <= most.get(r["source"], 0) for r in got.values())
    assert all(r["uses"] == 0 for r in got.values() if r["n_tokens"] == 0)
    size = min(most[s] * total[s] / x for s, x in (("a", 0.5), ("b", 0.3), ("c", 0.2)))
    used = {s: sum(r["uses"] * r["n_tokens"] for r in got.values() if r["source"] == s) for s in most}
    largest = {s: max(r["n_tokens"] for r in got.values() if r["source"] == s) for s in most}
    for s, x in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(used[s] - size * x) <= max(largest[s] / 2, 0.02 * size * x)
    # uses differ by at most one within a source
    for s in most:
        u = {r["uses"] for r in got.values() if r["source"] == s and r["n_tokens"]}
        assert max(u) - min(u) <= 1
    shares = {r["source"]: r for r in mixing.shares(uses, targets).collect()}
    assert shares["missing"]["actual_share"] == 0 and abs(sum(r["actual_share"] for r in shares.values()) - 1) < 1e-9
    empty = mixing.mix(mixing.sizes_of(docs.limit(0)), targets)
    assert empty.count() == 0 and mixing.shares(empty, targets).agg(F.sum("actual_share")).collect()[0][0] == 0
