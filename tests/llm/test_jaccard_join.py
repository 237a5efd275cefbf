"""The n-gram Jaccard join against all pairs."""

from __future__ import annotations

import os
import random
import re

import numpy as np
import pytest

from lumenloom.llm import jaccard_join as J
from lumenloom.llm import queries

SF = "/root/testdata/sf0.01"


def slow_set(text, n=3):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def slow(rows, num=90, count=False, n=3):
    sets = [slow_set(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by: dict = {}
    for i, s in enumerate(sets):
        for t in s:
            by.setdefault(t, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for t in s for j in by[t] if j > i}:
            if 100 * len(s & sets[j]) >= num * len(s | sets[j]):
                parent[root(j)] = root(i)
    if count:
        return len({root(i) for i in range(len(rows))})
    low: dict = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[root(i)] = min(low.get(root(i), k), k)
    return sorted(((k, len(s), low.get(root(i))) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str)


def near_copies(seed, groups, per, words=80):
    rnd = random.Random(seed)
    vocab = ["w%d" % i for i in range(3000)]
    rows = []
    for _ in range(groups):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(words // 2, words))]
        for _ in range(per):
            own = list(base)
            for _ in range(rnd.choice((0, 1, 1, 2, 3, 5))):
                own[rnd.randrange(len(own))] = rnd.choice(vocab)
            rows.append(" ".join(own))
    return rows


def odd_rows():
    texts = near_copies(1, 12, 8) + near_copies(2, 1, 120, 150) + [None, "", " \n\t ", "One two", "one TWO", "two one", "x", "x", "a b c", "a b c d", "A\tB\nC", " a b c", "a b c " * 4000]
    rnd = random.Random(3)
    common = " ".join("c%d" % i for i in range(40))
    texts += [common + " " + " ".join("z%d" % rnd.randrange(10_000) for _ in range(rnd.randint(1, 9))) for _ in range(60)]
    texts += texts[:6]
    return [(None if i % 29 == 7 else i - i % 17 // 16, t) for i, t in enumerate(texts)]


def run(spark, rows, **options):
    df = spark.createDataFrame([(k, t, "s", 1) for k, t in rows], "doc_id bigint, text string, sid string, size int").repartition(5)
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.components(df, **options).collect()), key=str)


def test_against_all_pairs(spark):
    rows = odd_rows()
    assert run(spark, rows) == slow(rows)


def test_blocks_and_other_thresholds(spark):
    rows = odd_rows()
    assert run(spark, rows, group_tokens=400, slices=3) == slow(rows)
    assert run(spark, rows, num=80) == slow(rows, 80)


def test_empty_and_wordless(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert J.components(df).count() == 0 and J.keep_one(df).count() == 0
    assert run(spark, [(1, None), (2, ""), (2, "")]) == [(1, 0, 1), (2, 0, 2), (2, 0, 2)]


def test_keep_one(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(k, t, "s", 1) for k, t in rows], "doc_id bigint, text string, none string, t1 int")
    out = J.keep_one(df)
    assert out.columns == df.columns
    want = slow(rows)
    kept = [r["doc_id"] for r in out.collect()]
    assert {c for _, n, c in want if n} - {None} <= set(kept) and len(kept) == slow(rows, count=True)


def test_group_linking_matches_pairs():
    rnd = random.Random(8)
    for _ in range(60):
        base = rnd.sample(range(1, 10_000), rnd.randint(1, 60))
        sets = []
        for _ in range(rnd.randint(2, 25)):
            s = set(base)
            for _ in range(rnd.randint(0, 6)):
                s.discard(rnd.choice(base))
                s.add(rnd.choice((rnd.randint(1, 10_000), rnd.randint(20_000, 20_010))))
            sets.append(s)
        ids = list(range(len(sets)))
        got = J.link_group(ids, [np.array(sorted(s), np.uint64) for s in sets])
        parent = list(ids)
        for _ in ids:
            for a in ids:
                for b in ids:
                    if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                        parent[a] = parent[b] = min(parent[a], parent[b])
        assert [got[i] for i in ids] == parent


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_query_on_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in queries.op7_jaccard_join(spark, SF).collect()), key=str)
    assert got == slow([(d["doc_id"], d["text"]) for d in docs])
