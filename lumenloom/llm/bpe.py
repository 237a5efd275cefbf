"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece the encoding has exactly one last token: the
token that fits the last token of the prefix before it, where two tokens fit
when encoding their joined bytes gives back just these two. Storing that token
per prefix gives exact appends (only new prefixes are computed) and exact
re-encoding near an edit (prefixes before the edit stay, those behind it are
computed until nothing more can change).

A text is cut by the vocabulary's pattern and each match is encoded alone; a
match that is itself a token is that token.

Defined cases: null text counts as empty and has no tokens; special tokens are
ordinary text; repeated rows are encoded alike; extra columns are ignored.
Memory per worker: the vocabulary, bounded memo tables and one Arrow batch.
Code points first assigned after Unicode 16 are classed as the ``regex`` library
does, which may be newer than other implementations of the pattern.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from lumenloom.llm.common import per_text

MEMO = 400_000
HEADS = (16, 12, 9, 7, 5, 3)


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Token bytes -> rank from a rank file; a vocabulary is a fixed-size parameter."""
    if "://" in path:
        lines = [r[0] for r in spark.read.text(path).collect()]
    else:
        with open(path) as f:
            lines = f.read().splitlines()
    pairs = (line.split() for line in lines if line.strip())
    return {base64.b64decode(a): int(b) for a, b in pairs}


class PrefixEncoder:
    """Encoder over one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {v: k for k, v in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.pattern = regex.compile(pattern)
        self._fits: dict[int, bool] = {}
        self._splits: dict[int, tuple[int, int] | None] = {}
        self._heads: dict[bytes, tuple[int, ...]] = {}  # tables of common prefixes, to append to
        sizes: dict[bytes, set[int]] = {}
        for token in ranks:
            sizes.setdefault(token[-3:], set()).add(len(token))
        #: lengths of the tokens that end in given three (or fewer) bytes, long ones first
        self.sizes = {k: tuple(sorted(v, reverse=True)) for k, v in sizes.items()}
        memo = self

        class Pieces(dict):
            def __missing__(self, piece: str) -> bytes:
                if len(self) >= MEMO:
                    self.clear()
                out = np.array(memo.encode_piece(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes()
                if len(piece) <= 64:
                    self[piece] = out
                return out

        self.pieces = Pieces()

    def _merge(self, data: bytes, below: int) -> list[int]:
        """Plain merging of a few bytes by ranks under ``below``; used to learn how a token is made."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if self.ranks.get(parts[best] + parts[best + 1], below) >= below:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``; None for a byte or a token no merge reaches."""
        known = self._splits.get(token, 0)
        if known == 0:
            data = self.tokens[token]
            known = None
            if len(data) > 1:
                halves = self._merge(data, below=token)
                if len(halves) == 2:
                    known = (halves[0], halves[1])
            self._splits[token] = known
        return known

    def stands_alone(self, token: int) -> bool:
        return len(self.tokens[token]) == 1 or self._split(token) is not None

    def fits(self, left: int, right: int) -> bool:
        """Does encoding the joined bytes give back just these two tokens?

        Merges are undone from the last to the first. At each point the two parts
        that touch must not merge before the merge that was undone last.
        """
        key = left << 32 | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= MEMO:
                self._fits.clear()
            known = self._fits[key] = self.stands_alone(left) and self.stands_alone(right) and self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        rank, tokens = self.ranks.get, self.tokens
        before = 1 << 60  # a merge across the border must not be earlier than this
        while True:
            across = rank(tokens[left] + tokens[right])
            if across is not None and across < before:
                return False
            a = left if len(tokens[left]) > 1 else -1
            b = right if len(tokens[right]) > 1 else -1
            if a < 0 and b < 0:
                return True
            if a > b:
                before, left = a, self._split(a)[1]
            else:  # equal merges run from left to right, so one across the border comes first
                before, right = b + 1, self._split(b)[0]

    def extend(self, data: bytes, last: list[int], stop: int | None = None) -> list[int]:
        """Fill ``last`` (last token of each prefix so far) up to ``stop`` bytes."""
        ranks, sizes, known, none = self.ranks, self.sizes, self._fits, ()
        for end in range(len(last) + 1, (len(data) if stop is None else stop) + 1):
            for tail in (data[max(0, end - 3) : end], data[max(0, end - 2) : end], data[end - 1 : end]):
                for size in sizes.get(tail, none):
                    before = end - size
                    if before < 0 or (token := ranks.get(data[before:end])) is None:
                        continue
                    if before == 0:
                        ok = self.stands_alone(token)
                    else:
                        ok = known.get(last[before - 1] << 32 | token)
                        if ok is None:
                            ok = self.fits(last[before - 1], token)
                    if ok:
                        last.append(token)
                        break
                else:
                    continue
                break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return last

    def read_back(self, last: list[int]) -> list[int]:
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(self.tokens[last[end - 1]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        last: list[int] = []
        for size in HEADS:
            if len(data) > size and (known := self._heads.get(data[:size])) is not None:
                last = list(known)
                break
        had = len(last)
        self.extend(data, last)
        if len(self._heads) >= MEMO // 4:
            self._heads.clear()
        for size in HEADS:
            if had < size < len(data):
                self._heads[data[:size]] = tuple(last[:size])
        return self.read_back(last)

    def replace(self, data: bytes, last: list[int], start: int, stop: int, new: bytes) -> tuple[bytes, list[int]]:
        """Prefix tokens after ``data[start:stop]`` became ``new``.

        A prefix's last token depends only on its last ``longest`` bytes'
        prefixes, so once that many tokens in a row are as before, the rest is too.
        """
        edited = data[:start] + new + data[stop:]
        out = last[:start]
        shift = len(data) - len(edited)
        same, end = 0, start + len(new)
        self.extend(edited, out, end)
        while end < len(edited) and same < self.longest:
            self.extend(edited, out, end + 1)
            same = same + 1 if out[end] == last[end + shift] else 0
            end += 1
        return edited, out + last[end + shift :]

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_ENCODERS: dict[tuple, PrefixEncoder] = {}


def _encoder(ranks: dict[bytes, int], pattern: str) -> PrefixEncoder:
    """One encoder per worker process, so that its memo tables outlive a task."""
    key = (pattern, hash(frozenset(ranks.items())))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = PrefixEncoder(ranks, pattern)
    return _ENCODERS[key]


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep: list[str] | None = None, digests: bool = False) -> DataFrame:
    """Append n_tokens and ids (array), or with ``digests`` their sha256 and that of the decoded bytes.

    ``ranks`` is broadcast: its size is that of the given vocabulary, not of the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    fields = {"n_tokens": "bigint"} | ({"ids_sha256": "string", "decoded_sha256": "string"} if digests else {"ids": "array<int>"})

    def make():
        encoder = _encoder(shared.value, pattern)

        def work(texts):
            out = {k: [] for k in fields}
            for data in texts:
                ids = encoder.encode_bytes((data or b"").decode("utf-8", "replace"))
                out["n_tokens"].append(len(ids) // 4)
                numbers = np.frombuffer(ids, "<u4")
                if digests:
                    out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(encoder.decode(numbers.tolist())).hexdigest())
                else:
                    out["ids"].append(numbers.astype(np.int32))
            return out

        return work

    return per_text(docs, text, make, fields, keep)


def decode_documents(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids", out: str = "text") -> DataFrame:
    """Append the decoded text of an id array; null ids decode to empty text."""
    from pyspark.sql import functions as F

    names = [c for c in encoded.columns if c != out]
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf("string")
    def decode(column):
        tokens = {v: k for k, v in shared.value.items()}
        return column.map(lambda x: b"".join(tokens[i] for i in x).decode("utf-8", "replace") if x is not None else "")

    return encoded.select(*names, decode(F.col(ids)).alias(out))
