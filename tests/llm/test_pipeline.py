"""The pipeline, stage by stage, against brute-force versions of its operators."""

from __future__ import annotations

import base64
import os
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from collections import Counter

from tests.llm.test_jaccard_join import slow
from tests.llm.test_scans import slow_scan

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def cut_repeats(texts, length=200):
    """Texts without repeated strings; characters that are only partly repeated stay."""
    data = [t.encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for t, d in zip(texts, data):
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept, at = [], 0
        for c in t:
            size = len(c.encode())
            if not gone[at : at + size].all():
                kept.append(c)
            at += size
        out.append("".join(kept))
    return out


def test_stages(spark, tmp_path):
    tiktoken = pytest.importorskip("tiktoken")
    P = pytest.importorskip("public_tokenizers")
    first = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "123 456 !!", "en", "s", 10), (9004, "A lonely text of words", None, None, 22)]
    docs = first.unionByName(spark.createDataFrame(odd, first.schema)).withColumn("lang_pred", first["source"])
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    want = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    states = [want]
    want = [(k, t) for k, t in want if k in {c for _, _, c in slow(want, 80, n=5)}]
    states.append(want)
    want = list(zip([k for k, _ in want], cut_repeats([t for _, t in want])))
    states.append(want)
    want = [(k, t) for k, t in want if not slow_scan(t, items)[-1]]
    states.append(want)
    assert len({len(s) for s in states}) > 2
    for (name, stage), state in zip(corpus_pipeline.STAGES[:4], states):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert sorted((r["doc_id"], r["text"]) for r in docs.collect()) == sorted(state), name
    with open(P.path(corpus_pipeline.VOCABULARY), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.STAGES[4][1](spark, docs, SF).collect()}
    assert got == {k: enc.encode_ordinary(t) for k, t in want}


def test_run_and_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids"]
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").where("false").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_language_stage_without_labels(spark):
    """Nothing to learn from: documents with a letter stay."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.language(spark, docs, SF)
    assert kept.columns == docs.columns
    assert kept.count() == docs.where(F.col("text").rlike("\\p{L}")).count() > 0
