"""Merge-list BPE with word ends: the last token of every prefix, found by a suffix automaton.

A text is normalised and cut into words by the vocabulary's own rules; the
last symbol of a word carries the word-end mark. For every prefix of a word
exactly one token can be the last of its encoding. A suffix automaton over all
tokens follows the word symbol by symbol; its state and match length give all
tokens that end there, long ones first. The one that is right is the token that
fits the stored last token of the prefix before it, where two tokens fit when
no merge across their border comes before a merge that made them. Back-pointers
(the token's length) then give the ids from the end.

Read from the vocabulary file: ``NFC``, ``Replace`` and ``Lowercase`` as
normalizers, an inverted ``Split`` with ``ByteLevel`` as pre-tokenizer, BPE
merges with a word-end suffix, special tokens. Anything else is refused.

Defined cases: null text counts as empty and has no tokens; special tokens'
strings in a text are those tokens, and what stands between two is normalised
for itself; repeated rows are encoded alike; other columns are carried along.
Memory per worker: the automaton, bounded memo tables and one Arrow batch.
Letters, numbers and white space are classed by Python's own character data.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenloom.llm.common import per_text

MEMO = 150_000
_MEMO_LETTERS = 64


def read_spec(spark: SparkSession, path: str) -> str:
    """The vocabulary file as text; a vocabulary is a fixed-size parameter."""
    if "://" in path:
        return spark.read.text(path, wholetext=True).first()[0]
    with open(path, encoding="utf-8") as f:
        return f.read()


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in such vocabularies.

    Fixed rule: visible Latin-1 characters stand for themselves, the other
    bytes for the code points from 256 on, in order.
    """
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class SuffixAutomaton:
    """All substrings of the tokens; ``ending`` lists the tokens that are suffixes of what was read.

    A state stands for substrings with the same right contexts, its link for
    their longest suffix with more of them. ``tokens[state]`` holds (length,
    token) of the tokens among the substrings of a state and of all states on
    its links, long ones first.
    """

    def __init__(self, words: list[tuple[tuple[int, ...], int]]):
        self.go: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for symbols, _ in words:
            last = 0
            for s in symbols:
                last = self._extend(last, s)
        self.tokens: list[tuple[tuple[int, int], ...]] = [()] * len(self.go)
        for symbols, token in words:
            state = 0
            for s in symbols:
                state = self.go[state][s]
            self.tokens[state] = tuple(sorted([*self.tokens[state], (len(symbols), token)], reverse=True))
        for state in sorted(range(1, len(self.go)), key=self.length.__getitem__):
            self.tokens[state] += self.tokens[self.link[state]]

    def _copy(self, state: int, parent: int, symbol: int) -> int:
        """A state of its own for the shorter substrings of ``state`` that end in parent + symbol."""
        new = len(self.go)
        self.go.append(dict(self.go[state]))
        self.length.append(self.length[parent] + 1)
        self.link.append(self.link[state])
        self.link[state] = new
        while parent >= 0 and self.go[parent].get(symbol) == state:
            self.go[parent][symbol] = new
            parent = self.link[parent]
        return new

    def _extend(self, last: int, symbol: int) -> int:
        known = self.go[last].get(symbol)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._copy(known, last, symbol)
        new = len(self.go)
        self.go.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        while last >= 0 and symbol not in self.go[last]:
            self.go[last][symbol] = new
            last = self.link[last]
        if last >= 0:
            known = self.go[last][symbol]
            self.link[new] = known if self.length[known] == self.length[last] + 1 else self._copy(known, last, symbol)
        return new

    def step(self, state: int, matched: int, symbol: int) -> tuple[int, int]:
        """State and length of the longest suffix, with ``symbol`` appended, that is in any token."""
        while symbol not in self.go[state]:
            if state == 0:
                return 0, 0
            state = self.link[state]
            matched = self.length[state]
        return self.go[state][symbol], matched + 1


class WordEncoder:
    """Encoder over one vocabulary file."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("only plain merge-list BPE is read")
        self.names: dict[int, str] = {i: t for t, i in model["vocab"].items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.specials.items()}
        self._special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self._steps, self._pieces = _text_rules(spec)
        self.joined = "" if spec.get("decoder") else " "
        if spec.get("decoder") or spec.get("post_processor"):
            raise ValueError("decoders and post-processors are not read")

        mark = model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        inner = {c: b for b, c in enumerate(letters)}

        def symbols(token: str) -> tuple[int, ...]:
            ends = bool(mark) and token.endswith(mark)
            plain = [inner[c] for c in (token[: -len(mark)] if ends else token)]
            return tuple([*plain[:-1], plain[-1] + 256] if ends else plain)

        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: rank of a merge by its two tokens, and what a token was merged from
        self.rank = {vocab[a] << 32 | vocab[b]: r for r, (a, b) in enumerate(pairs)}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            made = vocab[a + b]
            if made in self.parts or any(len(symbols(x)) > 1 and vocab[x] not in self.parts for x in (a, b)):
                raise ValueError("merges must make each token once, after its parts")
            self.parts[made] = (vocab[a], vocab[b], r)
        self._fits: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        words = [(symbols(t), i) for t, i in vocab.items()]
        self.single = {s[0]: i for s, i in words if len(s) == 1}
        self.automaton = SuffixAutomaton([w for w in words if len(w[0]) == 1 or w[1] in self.parts])
        self.ends = 256 if mark else 0
        memo = self

        class Words(dict):
            """Ids and names of words, in two generations so that common words outlive a full table."""

            older: dict[str, tuple[str, str]] = {}

            def __missing__(self, word: str) -> tuple[str, str]:
                out = self.older.get(word)
                if out is None:
                    ids = memo.encode_word(word.encode("utf-8", "surrogatepass"))
                    out = (" ".join(map(str, ids)), memo.joined.join(map(memo.names.__getitem__, ids)))
                    if len(word) > _MEMO_LETTERS:
                        return out
                if len(self) >= MEMO:
                    self.older = self.copy()
                    self.clear()
                self[word] = out
                return out

        self.words = Words()

    # --- pair compatibility -------------------------------------------------------------
    def is_made(self, token: int) -> bool:
        """Does merging the token's own symbols give the token?"""
        known = self._whole.get(token)
        if known is None:
            made = self.parts.get(token)
            known = made is None or (self.is_made(made[0]) and self.is_made(made[1]) and self._apart(made[0], made[1], made[2]))
            self._whole[token] = known
        return known

    def fits(self, left: int, right: int) -> bool:
        """Do the two tokens stay apart when their symbols are merged side by side?"""
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= 2 * MEMO:
                self._fits.clear()
            known = self._fits[key] = self.is_made(right) and self._apart(left, right, len(self.rank))
        return known

    def _apart(self, left: int, right: int, until: int) -> bool:
        """No merge across the border ranks before ``until``, nor before the merges that used up its sides.

        The merges that made the two tokens are undone from the last one on.
        Of equal merges the left one comes first, so a merge across the border
        is also too early when it equals the one that used up its right side.
        """
        rank, parts = self.rank.get, self.parts.get
        while True:
            if rank(left << 32 | right, until) < until:
                return False
            a, b = parts(left), parts(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[2] > b[2]):
                until, left = a[2], a[1]
            else:
                until, right = b[2] + 1, b[0]

    # --- words and texts ----------------------------------------------------------------------
    def last_tokens(self, symbols: list[int]) -> list[tuple[int, int]]:
        """(length, token): the last token of every prefix's encoding."""
        last: list[tuple[int, int]] = []
        step, tokens, known = self.automaton.step, self.automaton.tokens, self._fits.get
        state = matched = end = 0
        for symbol in symbols:
            state, matched = step(state, matched, symbol)
            end += 1
            for found in tokens[state]:
                length, token = found
                if length > matched:
                    continue
                if length == end:
                    ok = self.is_made(token)
                else:
                    left = last[end - length - 1][1]
                    ok = known(left << 32 | token)
                    if ok is None:
                        ok = self.fits(left, token)
                if ok:
                    last.append(found)
                    break
            else:
                raise ValueError(f"the vocabulary lacks symbol {symbol}")
        return last

    def encode_word(self, data: bytes) -> list[int]:
        symbols = list(data)
        symbols[-1] += self.ends
        last = self.last_tokens(symbols)
        out, end = [], len(last)
        while end:
            length, token = last[end - 1]
            out.append(token)
            end -= length
        return out[::-1]

    def _stretches(self, text: str):
        """Normalised words, and special tokens as ids."""
        at = 0
        for found in self._special.finditer(text) if self._special else ():
            yield self._pieces(self._normal(text[at : found.start()]))
            yield self.specials[found.group()]
            at = found.end()
        yield self._pieces(self._normal(text[at:]) if at else self._normal(text))

    def _normal(self, text: str) -> str:
        for step in self._steps:
            text = step(text)
        return text

    def encode_texts(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the decimal ids joined by a blank, and the decoded text."""
        ids, names = [], []
        word = self.words.__getitem__
        for stretch in self._stretches(text):
            if isinstance(stretch, int):
                ids.append(str(stretch))
                names.append(self.names[stretch])
            elif stretch:
                a, b = zip(*map(word, stretch))
                ids += a
                names += b
        joined = " ".join(ids)
        return joined.count(" ") + (joined != ""), joined, self.joined.join(names)

    def encode(self, text: str) -> list[int]:
        n, ids, _ = self.encode_texts(text)
        return [int(i) for i in ids.split(" ")] if n else []

    def decode(self, ids: list[int]) -> str:
        return self.joined.join(self.names[i] for i in ids)


def _lower(text: str) -> str:
    # letter by letter, without the rule for a sigma at a word's end
    return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()


#: what ``\s`` means in the patterns: the characters with the property White_Space
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@cache
def _members(kind: str, astral: bool) -> str:
    """The ranges of a general category's characters, as inside a bracket."""
    inside = [unicodedata.category(chr(c))[0] == kind for c in range(0x110000 if astral else 0x10000)] + [False]
    edges = [c for c in range(len(inside)) if inside[c] != (c > 0 and inside[c - 1])]
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(z - 1))}" for a, z in zip(edges[::2], edges[1::2]))


def _explicit(pattern: str, astral: bool) -> re.Pattern:
    """A pattern with its character properties written out; ``astral`` if texts go beyond the first 65536 code points."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        found = re.match(r"\\p\{(\w)\}|\\s", pattern[at:])
        if found:
            members = _members(found[1], astral) if found[1] else _SPACE
            out.append(members if inside else f"[{members}]")
            at += found.end()
            continue
        part = pattern[at : at + 2] if pattern[at] == "\\" else pattern[at]
        inside = part == "[" or (inside and part != "]")
        out.append(part)
        at += len(part)
    return re.compile("".join(out))


_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def _either(pattern: str, method: str):
    """A method of the pattern; the narrow form of it serves most texts and is faster."""
    narrow, wide = (getattr(_explicit(pattern, astral), method) for astral in (False, True))
    return lambda *args: (wide if _ASTRAL.search(args[-1]) else narrow)(*args)


def _text_rules(spec: dict):
    """Normalising steps and the function that lists words, from the file's rules."""
    cut = spec["pre_tokenizer"]
    parts = cut["pretokenizers"] if cut["type"] == "Sequence" else [cut]
    split = parts[0]
    plain = len(parts) == 2 and split["type"] == "Split" and split["behavior"] == "Removed" and split["invert"]
    if not plain or parts[1]["type"] != "ByteLevel" or parts[1]["add_prefix_space"] or parts[1]["use_regex"]:
        raise ValueError("only an inverted split followed by byte letters is read")
    words = _either(split["pattern"]["Regex"], "findall")
    blanks = re.findall(f"[{_SPACE}]", "".join(map(chr, range(0x3001))))
    no_blanks = all(b not in "".join(words(f"a{b}!{b}1")) for b in blanks)

    rules = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
    steps = []
    for rule in rules["normalizers"] if rules["type"] == "Sequence" else [rules]:
        if rule["type"] == "NFC":
            steps.append(lambda t: unicodedata.normalize("NFC", t))
        elif rule["type"] == "Lowercase":
            steps.append(_lower)
        elif rule["type"] == "Replace":
            pattern = rule["pattern"]["Regex"] if "Regex" in rule["pattern"] else re.escape(rule["pattern"]["String"])
            if pattern == r"\s+" and rule["content"] == " " and no_blanks:
                continue  # words hold no white space, so which kind stands between them changes nothing
            content = rule["content"].replace("\\", r"\\")  # taken as it stands
            steps.append(lambda t, sub=_either(pattern, "sub"), c=content: sub(c, t))
        else:
            raise ValueError(f"normalizer {rule['type']} is not read")
    return steps, words


_ENCODERS: dict[int, WordEncoder] = {}


def _encoder(spec: str) -> WordEncoder:
    """One encoder per worker process, so that its tables outlive a task."""
    key = hash(spec)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(spec)
    return _ENCODERS[key]


def encode_documents(docs: DataFrame, spec: str, text: str = "text", keep: list[str] | None = None, digests: bool = False) -> DataFrame:
    """Append n_tokens and ids (array), or with ``digests`` the sha256 of the joined decimal ids and of the decoded text.

    ``spec`` is broadcast: its size is that of the given vocabulary, not of the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    fields = {"n_tokens": "bigint"} | ({"ids_sha256": "string", "decoded_sha256": "string"} if digests else {"ids": "array<int>"})

    def make():
        encoder = _encoder(shared.value)

        def work(texts):
            out = {k: [] for k in fields}
            for data in texts:
                n, ids, decoded = encoder.encode_texts((data or b"").decode("utf-8", "replace"))
                out["n_tokens"].append(n)
                if digests:
                    out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest())
                else:
                    out["ids"].append([int(i) for i in ids.split(" ")] if n else [])
            return out

        return work

    return per_text(docs, text, make, fields, keep)


def decode_documents(encoded: DataFrame, spec: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """Append the decoded text of an id array; null ids decode to empty text."""
    names = [F.col(f"`{c}`") for c in encoded.columns if c != out]
    shared = encoded.sparkSession.sparkContext.broadcast(spec)

    @F.pandas_udf("string")
    def decode(column):
        encoder = _encoder(shared.value)
        return column.map(lambda x: encoder.decode(x) if x is not None else "")

    return encoded.select(*names, decode(F.col(f"`{ids}`")).alias(out))
