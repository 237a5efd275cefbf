"""BPE with word ends against the tokenizers library."""

from __future__ import annotations

import hashlib
import os
import random

import pytest

from lumenloom.llm import queries, word_bpe

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    out = tokenizers.Tokenizer.from_file(PATH)
    out.no_truncation()
    out.no_padding()
    return out


@pytest.fixture(scope="module")
def encoder():
    with open(PATH, encoding="utf-8") as f:
        return word_bpe.WordEncoder(f.read())


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_random_texts(library, encoder):
    rnd = random.Random(3)
    letters = {c: b for b, c in enumerate(word_bpe.byte_letters())}
    tokens = [bytes(letters[c] for c in name.removesuffix("</w>")) for name, i in library.get_vocab().items() if i < 49406]
    for n in range(6000):
        text = b"".join(rnd.choice(tokens) for _ in range(rnd.choice((1, 2, 3, 8)))).decode("utf-8", "replace")
        if n % 3 == 0:
            text = "".join(rnd.choice("aaabbthein'sxσΣ é!. \n1漢") for _ in range(rnd.randint(0, 60)))
        if n % 7 == 0:
            text += "<|endoftext|>" + text[:3] + "<|startoftext|>İIΣ é"
        ids, decoded = expected(library, text)
        assert encoder.encode(text) == ids, text
        assert encoder.encode_texts(text)[2] == encoder.decode(ids) == decoded


def test_long_words_without_memo(library, encoder):
    for text in ("a" * 5000, "ab" * 3000 + "!" * 4000, "thethe" * 2000, "'" * 999, "é" * 2001):
        assert encoder.encode(text) == expected(library, text)[0]


def test_automaton_lists_all_suffixes():
    rnd = random.Random(5)
    words = {tuple(rnd.choices(range(3), k=rnd.randint(1, 6))) for _ in range(60)} | {(0,), (1,), (2,)}
    numbered = {w: i for i, w in enumerate(sorted(words))}
    automaton = word_bpe.SuffixAutomaton(list(numbered.items()))
    text = tuple(rnd.choices(range(4), k=3000))  # symbol 3 is in no word
    state = matched = 0
    for end, symbol in enumerate(text, 1):
        state, matched = automaton.step(state, matched, symbol)
        found = [t for t in automaton.tokens[state] if t[0] <= matched]
        assert found == [(n, numbered[text[end - n : end]]) for n in range(min(end, 6), 0, -1) if text[end - n : end] in numbered]


def test_other_kinds_of_vocabularies_are_refused():
    with pytest.raises(ValueError):
        word_bpe.WordEncoder('{"model": {"type": "Unigram"}}')


def test_documents_with_odd_rows_and_names(spark, library):
    rows = [(1, None, "x"), (2, "", None), (3, "Hello WORLD  it's <|endoftext|>", "y"), (3, "Hello WORLD  it's <|endoftext|>", "y"), (None, "\t\n", "z"), (4, "wörd " * 20000, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, `n_tokens.x` string")
    spec = word_bpe.read_spec(spark, PATH)
    done = word_bpe.encode_documents(docs, spec)
    assert done.columns == ["doc_id", "text", "n_tokens.x", "n_tokens", "ids"]
    got = sorted(map(repr, ((r["doc_id"], r["text"], r["n_tokens"], list(r["ids"])) for r in done.collect())))
    assert got == sorted(map(repr, ((i, t, len(expected(library, t)[0]), expected(library, t)[0]) for i, t, _ in rows)))
    back = word_bpe.decode_documents(done.drop("text"), spec).collect()
    assert sorted(r["text"] for r in back) == sorted(expected(library, t)[1] for _, t, _ in rows)
    assert word_bpe.encode_documents(docs.limit(0), spec).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
def test_query_on_the_whole_table(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for d in docs:
        ids, decoded = expected(library, d["text"])
        want.add((d["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(decoded)))
    got = queries.op11_word_bpe(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert len(got) == len(docs) and set(map(tuple, got)) == want
