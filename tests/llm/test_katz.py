"""Katz backoff against a plain model of the same small corpus."""

from __future__ import annotations

import math
import os
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenloom.llm import katz, queries

SF = "/root/testdata/sf0.001"


def tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w] + [None]


class Plain:
    def __init__(self, texts):
        self.uni, self.bi = Counter(), defaultdict(Counter)
        for t in texts:
            last = "<s>"
            for w in tokens(t):
                self.uni[w] += 1
                self.bi[(last,)][w] += 1
                last = w
        self.total, self.distinct = sum(self.uni.values()), len(self.uni)
        self.du = katz.discounts(Counter(self.uni.values()))
        self.db = katz.discounts(Counter(c for x in self.bi.values() for c in x.values()))

    def cut(self, c, d):
        return d[c - 1] * c if c <= katz.K else c - katz.KEPT

    def unigram(self, w):
        if self.uni[w]:
            return self.cut(self.uni[w], self.du) / self.total
        return 1 - sum(self.cut(c, self.du) for c in self.uni.values()) / self.total if self.total else 1.0

    def prob(self, w, before):
        after = self.bi.get((before,))
        if not after:
            return self.unigram(w)
        n = sum(after.values())
        if after[w]:
            return self.cut(after[w], self.db) / n
        left = 1 - sum(self.cut(c, self.db) for c in after.values() if c) / n
        return left / (1 - sum(self.unigram(x) for x in list(after) if after[x])) * self.unigram(w)

    def judge(self, text):
        ts = tokens(text)
        base = sum(math.log10((self.uni[w] + 1) / (self.total + self.distinct + 1)) for w in ts)
        return len(ts), sum(self.uni[w] > 0 for w in ts), self.total, base, sum(math.log10(self.prob(w, b)) for b, w in zip(["<s>", *ts], ts))


def check(rows, docs, train):
    plain = Plain([t for k, t in docs if train(k)])
    want = sorted(((k, not train(k), *plain.judge(t)) for k, t in docs), key=lambda r: (str(r[0]), r[2:]))
    got = sorted((tuple(r) for r in rows), key=lambda r: (str(r[0]), r[2:]))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-6, abs=1e-6), (g, w)
    return plain


def corpus(seed=1, n=120):
    rnd = random.Random(seed)
    vocab = ["w%d" % int(rnd.paretovariate(0.8)) for _ in range(400)] + ["The", "É", "x|y"]
    docs = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 40)))) for i in range(n)]
    docs += [(n + i, "Licensed under the same words") for i in range(9)]
    return docs + [(500, None), (501, ""), (502, " \t\n"), (3, "unknown zz yy"), (3, "unknown zz yy"), (None, "w1 w1 w2 unheard")]


def train_on(k):
    return k is not None and k % 7 != 2


def test_against_plain_model(spark):
    docs = corpus()
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], "doc_id bigint, text string, score string, n bigint").repartition(4)
    out = katz.score(df, train=F.col("doc_id") % 7 != 2)
    plain = check(out.collect(), docs, train_on)
    for before in ["<s>", "w1", "under", "nothing"]:
        words = [w for w in plain.uni]
        assert sum(plain.prob(w, before) for w in words) + plain.prob("unheard of", before) == pytest.approx(1)


def test_nothing_frequent_or_everything(spark, monkeypatch):
    docs = corpus(2, 40)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    for share in (0.9, 0.005):
        monkeypatch.setattr(katz, "FREQUENT", share)
        check(katz.score(df, train=F.col("doc_id") % 7 != 2, slices=3).collect(), docs, train_on)


def test_nothing_to_learn_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in katz.score(df, train=F.lit(False)).collect()}
    assert rows[1]["score"] == 0 and rows[1]["base_score"] == 0 and rows[2]["n_tokens"] == 1 and rows[1]["train_tokens"] == 0
    assert katz.score(df.where("false")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_query_on_tables(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = queries.op4_katz(spark, SF).collect()
    check(rows, docs, lambda k: zlib.crc32(str(k).encode()) % 7 != 2)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_tokens_frequent_only_through_copies_are_found(spark):
    junk = [f"junk{i} " * 40 for i in range(20)]  # each text copied, so all its copies have one hash
    rows = [(100 * j + i, t) for j, t in enumerate(junk) for i in range(20)] + [(5000 + i, f"rare{i} other{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("cast(text AS binary) AS data", "true AS train")
    found = set(katz._frequent(docs.repartition(7)).tolist())
    assert {katz.word_hash(b"junk%d" % i) for i in range(20)} <= found and katz.word_hash(b"rare5") not in found


class Captured:
    """Stands for a frame; gives back the function that a task would run."""

    def repartition(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def sliced(monkeypatch, texts, traced=None):
    """What the tasks of the only slice make of texts, summed by kind and key; their largest memory in ``traced``."""
    monkeypatch.setattr(katz.TaskContext, "get", classmethod(lambda cls: SimpleNamespace(partitionId=lambda: 0)))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([i % 3 > 0 for i in range(len(texts))]), pa.array(texts, pa.binary())], names=["d", "train", "data"])
    frequent = np.array([katz.END], np.uint64)

    def peak(steps):
        tracemalloc.start()
        out = [b.to_pandas() if traced is None else b for b in steps]
        if traced is not None:
            traced.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        return out

    run = katz._send(Captured(), [0], frequent)
    sent = list(run([batch]))
    if traced is not None:
        peak(run([batch]))
    found = peak(katz._count(Captured(), 1, {katz.END: len(texts)})(iter(sent)))
    if traced is None:
        whole = pd.concat(found).reset_index(drop=True)
        return whole.groupby(["kind", "key", "other"]).sum().round(9), len(whole)


def test_blocks_change_no_sum(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(30))).encode() for _ in range(60)]
    whole, rows = sliced(monkeypatch, texts)
    monkeypatch.setattr(katz, "_TOKENS", 7)
    cut, more = sliced(monkeypatch, texts)
    assert more > rows and whole.index.equals(cut.index) and (whole - cut).abs().max().max() < 1e-6


def test_memory_of_a_task_is_a_few_words_per_token(monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(5000)]
    texts = [" ".join(rng.choices(words, k=1000)).encode() for _ in range(1000)]
    peaks = []
    sliced(monkeypatch, texts, peaks)
    dealt, counted = (p / 1_001_000 for p in peaks)
    assert dealt < 60 and counted < 90, (dealt, counted)
