"""Phrases from distinct chunks against plain counting."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from lumenloom.llm import collocations as co

DOCS = "doc_id bigint, lang string, text string, gram string, f int, score string"


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n\x0b\x0c\r]", low)]


def slow_counts(rows, max_n):
    out = defaultdict(Counter)
    for lang, text in rows:
        for p in pieces(text):
            for n in range(1, max_n + 1):
                out["und" if lang is None else lang].update(" ".join(p[i : i + n]) for i in range(len(p) - n + 1))
    return out


def slow_phrases(rows, min_n, max_n, at_least, covered, top):
    out = []
    for lang, f in slow_counts(rows, max_n).items():
        size = lambda g: g.count(" ") + 1
        phrases = {g: a for g, a in f.items() if min_n <= size(g) <= max_n and a >= at_least}
        scored = []
        for g, a in phrases.items():
            if any(size(h) > size(g) and f" {g} " in f" {h} " and 100 * b >= covered * a for h, b in phrases.items()):
                continue
            w = g.split(" ")
            cuts = [(1_000_000 * a * a // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            scored.append((-score, -a, g.encode(), g, f[" ".join(w[:k])], f[" ".join(w[k:])]))
        n = sum(v for g, v in f.items() if " " not in g)
        out += [(lang, r, g, -a, x, y, n, -s) for r, (s, a, _, g, x, y) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def corpus(seed, n):
    rnd = random.Random(seed)
    passage = " ".join(rnd.choices("alpha beta gamma delta eps".split(), k=400))
    vocabulary = [f"w{i}" for i in range(9)] + ["Élan", "élan", "a", "b.c", "x"]
    rows = []
    for i in range(n):
        text = "".join(rnd.choice(vocabulary) + rnd.choice([" ", "  ", "\t", ". ", "\n", ", "]) for _ in range(rnd.randint(0, 120)))
        rows.append((rnd.choice(["en", "fr", None, "und"]), text + (passage if i % 3 == 0 else "")))
    return [*rows, *rows[:5], ("en", None), ("en", ""), ("en", "..."), ("fr", "same same " * 6000), (None, "only")]


def table(spark, rows):
    return spark.createDataFrame([(i, lang, text, "g", 1, "s") for i, (lang, text) in enumerate(rows)], DOCS)


@pytest.mark.parametrize("overlap", [1, 2, 4])
def test_chunks_cover_a_text_once(monkeypatch, overlap):
    rnd = random.Random(overlap)
    monkeypatch.setattr(co, "_BLOCK", 700)
    for size in (0, 1, 2, 5, 5000):
        text = "".join(rnd.choice(["a ", "bb ", "c.", "dd\n", "e "]) for _ in range(size)) + "a " * size
        chunks = list(co.parse(text.encode(), overlap))
        own = [t for c in chunks for t in c[:-overlap]]
        want = [t for t in text.encode().translate(co._TABLE).replace(b".", b" . ").split(b" ") if t]
        assert own == want
        assert all(a[-overlap:] == b[:overlap] or len(b) < 2 * overlap for a, b in zip(chunks, chunks[1:]))
        assert all(len(c) <= co.LONGEST + overlap for c in chunks)


def test_equal_passages_share_chunks():
    rnd = random.Random(9)
    passage = " ".join(rnd.choices([f"w{i}" for i in range(500)], k=2000))
    parsed = [{b" ".join(c) for c in co.parse(f"{head} {passage} {head}".encode(), 2)} for head in ("one two three", "some thing else " * 50)]
    assert len(parsed[0] & parsed[1]) > 0.9 * len(parsed[0])


@pytest.mark.parametrize("max_n", [1, 3, 5])
def test_counts(spark, max_n):
    rows = corpus(max_n, 60)
    got = co.ngrams(co.dictionary(table(spark, rows), max_n=max_n), max_n, 3).collect()
    want = slow_counts(rows, max_n)
    assert {(r["lang"], r["gram"], r["f"]) for r in got if r["gram"]} == {(lang, g, a) for lang, f in want.items() for g, a in f.items() if a >= 3}
    assert {(r["lang"], r["f"]) for r in got if not r["gram"] and r["f"]} == {(lang, sum(v for g, v in f.items() if " " not in g)) for lang, f in want.items()}


@pytest.mark.parametrize("min_n, max_n, at_least, covered, top", [(2, 3, 10, 50, 2000), (2, 4, 4, 80, 7), (3, 3, 2, 50, 50)])
def test_phrases(spark, min_n, max_n, at_least, covered, top):
    rows = corpus(11, 80)
    got = co.collocations(table(spark, rows), min_n=min_n, max_n=max_n, at_least=at_least, covered=covered, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == slow_phrases(rows, min_n, max_n, at_least, covered, top)


def test_products_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", "x y", 3_000_000_000_001, 2, 1)], "lang string, gram string, f bigint, size int, k int")
    found = co._scores(counts.selectExpr("*", "3000000000007L AS l", "3000000000003L AS r")).first()
    a, l, r = 3_000_000_000_001, 3_000_000_000_007, 3_000_000_000_003
    assert found["score"] == 1_000_000 * a * a // (l * r)


def test_empty_table(spark):
    assert co.collocations(table(spark, [("en", None)]).limit(0)).count() == 0
    assert co.collocations(table(spark, [("en", None), (None, "")])).count() == 0
