"""Repeated substrings against a plain count of all strings."""

from __future__ import annotations

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest

from lumenloom.llm import queries, suffix_dedup as S

SF = "/root/testdata/sf0.001"


def slow(texts: list[str | None], length: int):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def mixture(seed: int, n: int, alphabet: str) -> list[str | None]:
    rnd = random.Random(seed)
    word = lambda k: "".join(rnd.choice(alphabet) for _ in range(k))
    shared = [word(rnd.randint(5, 90)) for _ in range(6)]
    texts: list[str | None] = [None, "", "a" * 150, word(40)]
    for _ in range(n):
        parts = [rnd.choice(shared) if rnd.random() < 0.5 else word(rnd.randint(0, 60)) for _ in range(rnd.randint(1, 6))]
        texts.append("".join(parts))
    texts += rnd.sample(texts, 5)
    edited = [t for t in texts if t and len(t) > 60][:5]
    return texts + [t[:30] + "é" + t[31:] for t in edited]


def table(spark, texts):
    rows = [(None if i % 11 == 5 else i // 2, t, "x", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_bytes string, row bigint").repartition(3)


@pytest.mark.parametrize("length,alphabet,seed", [(20, "ab", 1), (37, "abcdefghijé漢", 2), (8, "ab", 3), (64, "abcdefgh ", 4), (1, "ab", 5)])
def test_against_counting(spark, length, alphabet, seed):
    texts = mixture(seed, 40, alphabet)
    rows = S.removal_report(table(spark, texts), length=length, keep=["row"]).collect()
    got = {r["row"]: tuple(r)[1:] for r in rows}
    assert len(rows) == len(texts) and [got[i] for i in range(len(texts))] == slow(texts, length)


def test_large_groups_and_pieces(spark, monkeypatch):
    texts = mixture(7, 60, "abc")
    monkeypatch.setattr(S, "GROUP_ROWS", 3)
    rows = S.removal_report(table(spark, texts), length=24, keep=["row"]).collect()
    got = {r["row"]: tuple(r)[1:] for r in rows}
    assert [got[i] for i in range(len(texts))] == slow(texts, 24)
    long = np.frombuffer("".join(random.Random(1).choice("ab") for _ in range(5000)).encode(), np.uint8)
    whole = S.representatives(long, 40)
    for size in (64, 333, 4990):
        monkeypatch.setattr(S, "_PIECE", size)
        parts = S.representatives(long, 40)
        order = np.argsort(parts["place"])
        assert all(np.array_equal(whole[k], parts[k][order]) for k in whole)


def test_text_removal_keeps_columns_and_characters(spark):
    line = "éàü漢字 some shared words that repeat " * 3
    texts = ["start " + line + "end", line + "other", None, "", "lonely text"]
    df = table(spark, texts)
    out = S.remove_repeats(df, length=30)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    got = {r["row"]: r["text"] for r in out.collect()}
    assert got[2] is None and got[3] == "" and got[4] == "lonely text" and got[0] == "starend" and got[1] == "other"
    assert S.remove_repeats(df.where("false")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_query_on_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    want = dict(zip([d["doc_id"] for d in docs], slow([d["text"] for d in docs], 200)))
    rows = queries.op1_suffix_dedup(spark, SF).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in rows} == want and len(rows) == len(docs)
