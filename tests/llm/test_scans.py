"""Winnowing, chat formatting, URL filters, decontamination, toxicity and language ID on small inputs."""

from __future__ import annotations

import hashlib
import os
import random
import re

import numpy as np
import pytest

from lumenloom.llm import bpe, chat, decontaminate, langid, queries, toxicity, url_filter, winnow

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
DOCS = "doc_id bigint, text string, score string, verdict string"
ODD = [
    (3, "The quick brown fox " * 40, "x", None),
    (1, None, None, None),
    (2, "", "", ""),
    (4, "ab", "1", "2"),
    (4, "ab", "1", "2"),
    (5, "éß漢字 <|im_end|> 12", None, "v"),
    (None, "no id here", None, None),
]


def table(spark, rows=ODD):
    return spark.createDataFrame(rows, DOCS)


def slow_fingerprint(hashes, window):
    picked = []
    window = min(window, len(hashes))
    for i in range(len(hashes) - window + 1):
        part = hashes[i : i + window]
        low = min(part)
        at = i + max(j for j, h in enumerate(part) if h == low)
        if not picked or picked[-1] != at:
            picked.append(at)
    return picked


def test_winnowing_selects_rightmost_minima():
    rnd = random.Random(1)
    for size in (1, 5, 20, 200, 900):
        for alphabet in ("ab", "abcdefghé漢"):
            codes = winnow.code_points("".join(rnd.choice(alphabet) for _ in range(size)).encode())
            for k, window in ((3, 4), (16, 64), (5, 1)):
                hashes, places = winnow.fingerprint(codes, k, window)
                every = [int(x) for x in winnow._rolling(codes, min(k, size))]
                want = slow_fingerprint(every, window)
                assert places.tolist() == want and hashes.tolist() == [every[i] for i in want]


def test_winnowing_in_pieces(monkeypatch):
    codes = winnow.code_points("".join(random.Random(2).choice("abc") for _ in range(5000)).encode())
    whole = winnow.fingerprint(codes, 7, 30)
    for size in (100, 333, 4964, 4999):
        monkeypatch.setattr(winnow, "_PIECE", size)
        for a, b in zip(whole, winnow.fingerprint(codes, 7, 30)):
            assert a.tolist() == b.tolist()


def check_compared(rows, docs):
    """``docs`` in order; every row's edited text and likeness follow from the next one."""
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for i, (key, text) in enumerate(docs):
        nxt = docs[(i + 1) % len(docs)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + nxt[:cut]
        own, other = (set(winnow.fingerprint(winnow.code_points(t.encode()))[0].tolist()) for t in (text, nxt))
        want = len(own & other) / len(own | other) if own | other else 1.0
        sha = hashlib.sha256(edited.encode()).hexdigest()
        assert any(r["n_chars"] == len(text) and r["edited_sha256"] == sha and abs(r["near_next"] - want) < 1e-12 for r in by[key])


def test_compare_with_next_on_odd_rows(spark):
    rows = winnow.compare_with_next(table(spark)).collect()
    assert len(rows) == len(ODD)
    docs = sorted(((k, t or "") for k, t, *_ in ODD), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    check_compared(rows, docs)
    assert winnow.compare_with_next(table(spark, [])).count() == 0
    alone = winnow.compare_with_next(table(spark, [(7, "abcdefgh" * 30, None, None)])).first()
    assert alone["near_next"] == 1.0


@needs_data
def test_compare_with_next_on_tables(spark):
    rows = queries.op3_fingerprints(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    assert len(rows) == len(docs)
    check_compared(rows, [(r["doc_id"], r["text"] or "") for r in docs])
    assert np.mean([r["near_edited"] for r in rows]) > 0.5 > 0.2 > np.mean([r["near_next"] for r in rows])
    prints = {}
    for r, d in zip(sorted(rows, key=lambda r: r["doc_id"]), docs):
        assert prints.setdefault(d["text"], r["fingerprint"]) == r["fingerprint"]


def test_fingerprints_keep_columns(spark):
    out = winnow.fingerprints(table(spark)).collect()
    assert len(out) == len(ODD) and {"score", "verdict", "hashes", "positions"} <= set(out[0].asDict())


# --- chat ----------------------------------------------------------------------------
def spec():
    P = pytest.importorskip("public_tokenizers")
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


TRICKY = ["<|im_end|><|im_start|>assistant ok", "<\\|x", "", None, " lead and trail \n\n", "漢字 emoji 🙂🙂 é", "a<|", "\\<|\\|>", "x" * 300]


def test_chat_round_trip(spark):
    turns = [(c, i, ("assistant", "user", None, "sys\ntem\\")[(c + i) % 4], TRICKY[(c * 3 + i) % len(TRICKY)], "extra") for c in range(9) for i in range(6)]
    turns += [(None, 0, "assistant", "nameless", "e"), (3, 2, "assistant", "again", "e"), (3, 2, "assistant", "again", "e")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string, formatted string")
    out = {r["conv_id"]: r for r in chat.format_conversations(df, spec()).collect()}
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df, spec())).collect()}
    by = {}
    for c, n, r, t, _ in turns:
        by.setdefault(c, []).append((n, r or "", t or ""))
    assert set(out) == set(by)
    for c, rows in by.items():
        rows.sort()
        told = "".join(f"{r}\n{t}\n" for _, r, t in rows)
        learned = "".join(t for _, r, t in rows if r == "assistant")
        assert back[c]["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert back[c]["loss_chars"] == len(learned) and back[c]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
        assert chat.parse(out[c]["formatted"]) == [(r, t) for _, r, t in rows] and out[c]["n_turns"] == len(rows)
        assert len(out[c]["ids"]) == len(out[c]["loss"]) == len(out[c]["offsets"]) // 2
    assert chat.format_conversations(df.where("false"), spec()).count() == 0


def test_chat_blocks_equal_whole(monkeypatch):
    tok = chat._tokenizer(spec())
    turns = [(("user", "assistant")[i % 2], (TRICKY[i % len(TRICKY)] or "") * 3) for i in range(60)]
    whole = chat.format_turns(turns, tok, "assistant")
    monkeypatch.setattr(chat, "BLOCK", 50)
    parts = chat.format_turns(turns, tok, "assistant")
    assert whole["formatted"] == parts["formatted"] and all(np.array_equal(whole[k], parts[k]) for k in ("ids", "offsets", "loss", "loss_spans"))


@needs_data
def test_chat_query(spark):
    rows = {r["conv_id"]: r for r in queries.op10_chat(spark, SF).collect()}
    turns = spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect()
    by = {-1: [("user", TRICKY[0]), ("assistant", TRICKY[0])]}
    for t in turns:
        by.setdefault(t["conv_id"], []).append((t["role"], t["text"] or ""))
    assert set(rows) == set(by)
    for c, ts in by.items():
        learned = "".join(t for r, t in ts if r == "assistant")
        assert rows[c]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
        assert rows[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest()


# --- URL filter ------------------------------------------------------------------------
def test_url_parts_and_rules(spark):
    urls = [(1, "HTTP://A.Example.ORG/es/x?q"), (2, None), (3, "nothing"), (4, "x://b.com?u=/de/"), (5, "http://c.de#f/"), (6, "http://notexample.org/es/"), (6, "http://www.x.com/de/1"), (7, "")]
    pages = spark.createDataFrame(urls, "page_id bigint, url string").selectExpr("*", "'z' AS host", "'y' AS rule")
    bad = spark.createDataFrame([(4, 1), (5, None), (None, 1), (99, 1)], "page_id bigint, bad int")
    out = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, bad, queries.RULES).fillna("-").collect())
    assert out[0] == (1, "a.example.org", "/es/x", "example.org/es/", "block")
    assert out[1][1:4] == ("", "", "-") and out[2][1:4] == ("", "", "-")
    assert out[3][1:4] == ("b.com", "", "-") and out[4][1:3] == ("c.de", "")
    assert ("notexample.org", "/es/", "org/", "allow") in [o[1:] for o in out] and ("www.x.com", "/de/1", "com/de/", "block") in [o[1:] for o in out]
    assert len(out) == len(urls)
    salted = url_filter.judge(pages, bad, queries.RULES, broadcast_rows=0).fillna("-").collect()
    assert sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in salted) == out
    assert url_filter.judge(pages.where("false"), bad, queries.RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, bad.where("false"), []).collect()} == {"allow"}


def test_reputation_blocks_bad_hosts_and_shrinks_rare_ones(spark):
    rows = [(i, f"http://{'spam' if i < 300 else 'good'}{i % 3}.site{'1' if i < 300 else '2'}.com/p") for i in range(600)] + [(600, "http://new.site1.com/"), (601, "http://new.site2.com/")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    bad = spark.createDataFrame([(i, int(i < 280)) for i in range(600)], "page_id bigint, bad int")
    by = {r["host"]: r for r in url_filter.judge(pages, bad, []).collect()}
    assert by["spam0.site1.com"]["verdict"] == "block" and by["good0.site2.com"]["verdict"] == "allow"
    assert by["new.site1.com"]["bad_rate"] > 0.6 > 0.3 > by["new.site2.com"]["bad_rate"]


# --- decontamination ----------------------------------------------------------------------
def slow_scan(text, items, width=10):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    w = words(text)
    hit, found = set(), set()
    for key, t in items:
        iw = words(t)
        for win in {tuple(iw[i : i + width]) for i in range(max(1, len(iw) - width + 1))} if iw else ():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found |= {str(key)} if key is not None else set()
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def test_decontamination_both_ways(spark):
    rnd = random.Random(5)
    vocab = ["a", "B", "c", "É", "e9", "日本"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice((0, 1, 3, 10, 12))))) for i in range(12)] + [(None, "c c c B B"), (40, None), (41, "")]
    items += [(7, items[3][1])]
    texts = [" ".join(rnd.choice(vocab) + rnd.choice(("", ".", "!?")) for _ in range(rnd.choice((0, 2, 9, 60)))) for _ in range(40)]
    docs = [(i % 30, t, None, None) for i, t in enumerate(texts)] + [(50, "x " + (items[4][1] or "c"), "1", "2"), *ODD]
    df, bench = table(spark, docs), spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS doc_id")
    want = sorted((str(k), *slow_scan(t, items)) for k, t, *_ in docs)
    for most in (1000, 0):
        got = decontaminate.scan_documents(df, bench, max_windows=most, keep=["doc_id"]).collect()
        assert sorted((str(r["doc_id"]), *r[1:]) for r in got) == want
    kept = decontaminate.remove_contaminated(df, bench)
    assert kept.columns == df.columns and kept.count() == sum(not w[-1] for w in want)
    cut = decontaminate.remove_spans(df, bench)
    assert cut.columns == df.columns and cut.count() == len(docs)
    assert decontaminate.scan_documents(df, bench.where("false")).where("contaminated").count() == 0
    assert decontaminate.scan_documents(df.where("false"), bench).count() == 0


def test_spans_are_cut_both_ways(spark):
    rnd = random.Random(7)
    vocab = ["a", "B", "c", "É", "e9", "日本"]
    items = spark.createDataFrame([(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice((1, 3, 10, 12))))) for i in range(12)], "item_id bigint, text string").where("text not in ('a', 'c')")
    docs = table(spark, [(i, " ".join(rnd.choice(vocab) + rnd.choice(("", ".", "!?")) for _ in range(40)), "s", None) for i in range(30)] + ODD)
    cut, joined = (decontaminate.remove_spans(docs, items, max_windows=most) for most in (1000, 0))
    assert joined.columns == docs.columns and sorted(map(str, cut.collect())) == sorted(map(str, joined.collect()))
    assert sorted(map(str, cut.collect())) != sorted(map(str, docs.collect()))


def test_words_of_a_long_text(monkeypatch):
    text = ("Wörd one2 " * 300).encode()
    want = text.translate(decontaminate._TABLE).split()
    monkeypatch.setattr(decontaminate, "_BLOCK", 64)
    assert [w for part in decontaminate.split_words(text) for w in part] == want


# --- toxicity and language ID -----------------------------------------------------------------
@needs_data
def test_toxicity_held_out(spark):
    big = "/root/testdata/sf0.1"
    out = queries.op8_toxicity(spark, big)
    assert out.columns == ["doc_id", "held_out", "score", "predicted"]
    judged = out.join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out").toPandas()
    right = (judged["predicted"] == judged["toxic"]).mean()
    caught = judged[judged["toxic"] == 1]["predicted"].mean()
    assert right > 0.97 and caught > 0.85, (right, caught)


def test_toxicity_tolerates_gaps_and_odd_rows(spark):
    rnd = random.Random(3)
    clean = ["hello", "morning", "garden", "window", "market", "yellow"]
    rows = [(i, " ".join(rnd.choice(clean) for _ in range(12)) + (" idiot" if i % 3 == 0 else "") + (" worthless" if i % 6 == 0 else ""), None, None) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (5000, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(table(spark, rows), labels)
    tests = [(1, "garden id-iot window", "", ""), (2, "you i d i o t", "", ""), (3, "garden window", "", ""), (4, None, "", ""), (5, "", "", ""), (6, "idxiot", "", ""), (6, "w" * 5000, "", "")]
    got = [r["predicted"] for r in toxicity.score(table(spark, tests), model).orderBy("doc_id", F_length()).collect()]
    assert got == [1, 1, 0, 0, 0, 1, 0]
    one = toxicity.fit(table(spark, rows), labels.where("toxic = 0"))
    assert {r["score"] for r in toxicity.score(table(spark), one).collect()} == {0.0}
    assert toxicity.score(table(spark, []), model).count() == 0
    assert toxicity.fit(table(spark, []), labels)["share"] == 0.0


def test_toxicity_counts_repetitions(spark):
    rnd = random.Random(6)
    clean = ["hello", "morning", "garden", "window", "market", "yellow"]
    text = lambda n: " ".join(rnd.sample([rnd.choice(clean) for _ in range(60 - n)] + ["bomentec"] * n, 60))
    rows = [(i, text(6 if i % 3 == 0 else i % 2), None, None) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id bigint, toxic int")
    model = toxicity.fit(table(spark, rows), labels)
    tests = [(1, text(1), None, None), (2, text(6), None, None), (3, text(0), None, None), (4, text(9), None, None)]
    assert {r["doc_id"]: r["predicted"] for r in toxicity.score(table(spark, tests), model).collect()} == {1: 0, 2: 1, 3: 0, 4: 1}


HIDDEN = ["i*d*i*o*t", "i*d*iot", "id.iot", "i.d.i.o.t", "id!iot", "i|d|iot", "i d  i o t", "i. d. i. o. t.", "st!upid", "stu--pid", "s*t*upid", "mo.r|on", "m*ron", "idxxiot", "ixdixot", "stuyypid", "sxtuypid"]
PLAIN = ["well.known", "e.g.", "a b c d", "garden|window", "mor-ning", "3.14", "market!yellow", "https://www.example.org/window", "moment"]


def test_toxicity_sees_through_several_insertions(spark):
    rnd = random.Random(8)
    clean = ["hello", "morning", "garden", "window", "market", "yellow"]
    rows = [(i, " ".join(rnd.choice(clean) for _ in range(12)) + (" " + rnd.choice(["idiot", "stupid", "moron"]) if i % 3 == 0 else ""), None, None) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(600)], "doc_id bigint, toxic int")
    model = toxicity.fit(table(spark, rows), labels)
    tests = [(i, f"garden {w} window", None, None) for i, w in enumerate(HIDDEN + PLAIN)]
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(table(spark, tests), model).collect()}
    assert [w for i, w in enumerate(HIDDEN) if not got[i]] == [] and [w for i, w in enumerate(PLAIN, len(HIDDEN)) if got[i]] == []


def F_length():
    from pyspark.sql import functions as F

    return F.length("text")


def test_kernel_norms_match_plain_sums():
    words = ["idiot", "aaaa", "ab", "", "abcabcabc", "zürich"]
    codes, weights = toxicity._subsequences(words)
    for row, got in zip(codes, toxicity._norms(codes, weights)):
        sums = {}
        for c, w in zip(row, weights):
            if c:
                sums[c] = sums.get(c, 0) + w
        assert abs(got - sum(v * v for v in sums.values()) ** 0.5) < 1e-4


@needs_data
def test_language_held_out(spark):
    rows = queries.op9_language_id(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (rows["lang"] == rows["lang_pred"]).mean() > 0.99


def test_language_odd_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(i, ("the cat sat on the mat " if i % 2 else "le chat est dans la maison ") * 3, "en" if i % 2 else "fr") for i in range(40)] + [(99, "zzz", None), (100, None, "en")], "doc_id bigint, text string, lang string")
    model = langid.fit(docs)
    tests = spark.createDataFrame([(1, "the mat", "fr"), (2, "la maison", None), (3, None, "en"), (4, "", "en"), (5, "12 !! 3", "en"), (5, "12 !! 3", "en")], "doc_id bigint, text string, score string")
    got = sorted((r["doc_id"], r["lang_pred"]) for r in langid.predict(tests, model).collect())
    assert got == [(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und"), (5, "und")]
    empty = langid.fit(docs.where("false"))
    assert {r["lang_pred"] for r in langid.predict(tests, empty).collect()} == {"und"}
    whole = [np.sort(h) for h in langid._gram_pieces(b"the cat sat on the mat", 512, (2, 3))]
    monkeypatch.setattr(langid, "_PIECE", 5)
    cut = list(langid._gram_pieces(b"the cat sat on the mat", 512, (2, 3)))
    assert np.array_equal(np.sort(np.concatenate(whole)), np.sort(np.concatenate(cut)))


# --- BPE -----------------------------------------------------------------------------------------
def vocabulary():
    P = pytest.importorskip("public_tokenizers")
    import base64

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, P.PATTERN


def test_bpe_equals_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks, pattern = vocabulary()
    want = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.PrefixEncoder(ranks, pattern)
    rnd = random.Random(9)
    texts = ["", " ", "a" * 3000, "don't WE'll\n\n x  ", "<|endoftext|>", "!?" * 400] + ["".join(rnd.choice("abcdeth é漢🙂\n1!'s") for _ in range(200)) for _ in range(200)]
    for t in texts:
        assert encoder.encode(t) == want.encode_ordinary(t)
        assert encoder.decode(encoder.encode(t)) == t.encode()
    df = table(spark)
    out = bpe.encode_documents(df, ranks, pattern)
    assert {(r["doc_id"], tuple(r["ids"])) for r in out.collect()} == {(k, tuple(want.encode_ordinary(t or ""))) for k, t, *_ in ODD}
    again = bpe.decode_documents(out.drop("text"), ranks)
    assert sorted((str(r["doc_id"]), r["text"]) for r in again.collect()) == sorted((str(k), t or "") for k, t, *_ in ODD)


def test_bpe_appends_and_edits():
    ranks, pattern = vocabulary()
    encoder = bpe.PrefixEncoder(ranks, pattern)
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abcdeth") for _ in range(n)).encode()
    for _ in range(400):
        data = word(rnd.randint(1, 60))
        last = encoder.extend(data, [])
        grown = encoder.extend(data + b"ing", list(last))
        assert grown == encoder.extend(data + b"ing", [])
        i, j = sorted((rnd.randint(0, len(data)), rnd.randint(0, len(data))))
        edited, table_ = encoder.replace(data, last, i, j, word(rnd.randint(0, 5)))
        assert table_ == encoder.extend(edited, [])


def test_columns_with_any_name(spark):
    """Columns named like helpers' own, and with dots, come through every scan."""
    names = ["doc_id", "text", "ids", "_row", "_text", "_letter", "a.b", "bytes", "c0", "n0"]
    rows = [(i, t, "i", "r", "t", "l", "ab", "b", "c", "n") for i, t in enumerate(["one two three four five six seven eight nine ten eleven", None, "Guten Tag", ""])]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {'bigint' if n == 'doc_id' else 'string'}" for n in names))
    items = spark.createDataFrame([("q", "two three four five six seven eight nine ten eleven")], "item_id string, text string")
    for most in (10, 0):
        out = decontaminate.scan_documents(docs, items, max_windows=most)
        assert out.columns[: len(names)] == names
        got = {r["doc_id"]: r for r in out.collect()}
        assert [got[i]["n_hit"] for i in range(4)] == [10, 0, 0, 0]
        assert all(tuple(got[i])[2 : len(names)] == rows[i][2:] for i in range(4))
    model = langid.fit(spark.createDataFrame([(1, "Guten Tag", "de"), (2, "one two three", "en")], "doc_id bigint, text string, lang string"))
    out = langid.predict(docs, model)
    assert out.columns == [*names, "lang_pred", "score"]
    assert {r["doc_id"]: (r["lang_pred"], r["_letter"], r["a.b"]) for r in out.collect()} == {0: ("en", "l", "ab"), 1: ("und", "l", "ab"), 2: ("de", "l", "ab"), 3: ("und", "l", "ab")}


def test_decontamination_sql_has_no_end(spark, tmp_path):
    """A window after word 19 999 of an item counts in the SQL as in the query."""
    import duckdb

    words = [f"w{i}" for i in range(20_050)]
    spark.createDataFrame([(1, " ".join(words[20_020:20_040])), (2, "none")], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, " ".join(words))], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({queries.OP5_SQL})").fetchall()
    got = queries.op5_decontamination(spark, str(tmp_path)).select(*cols).collect()
    assert sorted(map(tuple, got)) == sorted(want) and {r[0]: r[2] for r in want} == {1: 20, 2: 0}
