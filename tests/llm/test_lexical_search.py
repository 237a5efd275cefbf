"""Dual-tree search against scoring of all pairs."""

from __future__ import annotations

import random
import re

import numpy as np

from lumenloom.llm import lexical_search as ls

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in WORD.findall(text or "")]


def slow_ranks(docs, items, top=10):
    parts = [(i, words(t)) for i, t in docs]
    parts = [(i, w) for i, w in parts if w]
    total, length = len(parts), sum(len(w) for _, w in parts)
    out = []
    for item, text in items:
        terms = set(words(text))
        weights = {t: ls.weight(total, sum(t in w for _, w in parts)) for t in terms}
        scored = []
        for i, w in parts:
            m = 10 + 90 * len(w) * total // length
            score = sum(weights[t] * (1_000_000_000 * w.count(t) // (1000 * w.count(t) + 8 * m)) for t in terms if t in w)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def ranked(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id bigint, text string, score string")
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, rank int")
    got = ls.rank_documents(d, q, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=repr)


def corpus(rnd, n):
    topics = [[f"t{k}w{j}é" for j in range(12)] for k in range(8)]
    common = ["the", "of", "and", "to"]
    make = lambda: " ".join(rnd.choices(rnd.choice(topics), k=rnd.randint(1, 15)) + rnd.choices(common, k=rnd.randint(0, 20)))
    docs = [(i, make()) for i in range(n)]
    docs += [(n + i, docs[i % 7][1]) for i in range(n // 3)]  # copies, so that scores tie
    return docs, [(f"i{k}", make()) for k in range(30)]


def test_all_pairs_agree(spark):
    docs, items = corpus(random.Random(1), 400)
    want = slow_ranks(docs, items)
    assert ranked(spark, docs, items) == want
    assert ranked(spark, docs, items, block_terms=40) == want  # several blocks of items


def test_defined_cases(spark):
    docs = [(3, "Apple pie!"), (1, "apple PIE"), (1, "apple PIE"), (None, "apple pie"), (2, None), (4, ""), (5, "?!"), (6, "pear " * 30000), (7, "Ünïcode")]
    items = [("a", "apple"), ("a", "apple"), ("n", None), ("e", ""), (None, "pear apple"), ("u", "ünïcode ÜNÏCODE"), ("z", "zebra")]
    assert ranked(spark, docs, items) == slow_ranks(docs, items)
    assert ranked(spark, docs, items, top=2) == slow_ranks(docs, items, top=2)
    assert ranked(spark, [], items) == [] and ranked(spark, docs, []) == []


def block(rnd, n_docs, n_items, width, topics):
    """Vectors around topics, as postings and item terms."""
    rng = np.random.default_rng(rnd)
    near = [rng.choice(width, 12, replace=False) for _ in range(topics)]
    row, code, value = [], [], []
    for i in range(n_docs):
        for c in np.unique(np.append(rng.choice(near[rng.integers(topics)], 6), rng.integers(0, width, 2))):
            row.append(i), code.append(c), value.append(int(rng.integers(1, 900_000)))
    terms = [sorted(set(rng.choice(near[i % topics], 8).tolist())) for i in range(n_items)]
    return np.array(row), np.array(code), np.array(value, np.int64), terms, rng.integers(0, 9000, width)


def test_bounds_prune_and_lose_nothing():
    for seed, n_docs in ((1, 1500), (2, 37), (3, 16), (4, 1)):
        row, code, value, terms, weights = block(seed, n_docs, 45, 300, 9)
        ids = np.random.default_rng(seed).permutation(n_docs * 3)[:n_docs].astype(np.int64)
        dense = np.zeros((n_docs, 300), np.int64)
        dense[row, code] = value
        found = ls.Items(terms, weights, np.bincount(code, minlength=300), 5, {})
        computed = sum(ls.search(found, ls.Documents(ids[a:z], row[m] - a, code[m], value[m], weights, 300)) for a, z, m in parts(row, n_docs))
        for at, i in enumerate(found.order):
            scores = dense[:, terms[i]] @ weights[terms[i]]
            best = np.lexsort((ids, -scores))[:5]
            want = [(int(scores[k]), int(ids[k])) for k in best if scores[k] > 0]
            got = [(int(s), int(d)) for s, d in zip(found.scores[at], found.ids[at]) if s > 0]
            assert got == want
        if n_docs > 1000:
            assert computed < n_docs * 45 / 3  # most pairs are never scored


def parts(row, n_docs, step=500):
    for a in range(0, n_docs, step):
        z = min(a + step, n_docs)
        yield a, z, (row >= a) & (row < z)
