"""Katz backoff scoring with Good-Turing discounts.

A token's probability after the word before it is its discounted bigram count
over the count of that word; if the pair was never learned, the unigram
probability times the word's backoff weight; an unknown token gets the mass
that the unigram discounts leave. Counts up to ``K`` are discounted by
Good-Turing, larger ones by a hundredth of a count, so every context leaves
some mass and every distribution sums to one exactly.

All tokens, with the word before and their document, are dealt out to slices by
the token, packed per batch of documents. A slice knows all pairs of its tokens
and so both counts. It writes tables partitioned by kind: what each document
and each context add up to, still in terms of the discounts (they depend on all
slices), and the pairs that were not learned. Discounts then turn the context
table into backoff weights, which are joined to the unlearned pairs only: the
count of a word as a context is its own count, so learned pairs need no join.
Tokens that are frequent (found and counted on all texts) are
dealt out by the word before as well; which ones does not change any result.

Defined cases: null texts count as empty, and an empty text is one end token;
repeated rows and rows with equal or null ids are texts of their own (a null id
is hashed as empty text); without anything to learn from each token has
probability one; extra columns are ignored. Contexts are told apart by 48 bits
of a hash, tokens by 64.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.common import even_keys, prepare
from lumenloom.runtime import ensure_checkpoint_dir

K = 5
KEPT = 0.01  # taken from every larger count
FREQUENT = 1e-3  # share of tokens from which a token is dealt out over all slices
_BLOCK = 1 << 20
_TOKENS = 1 << 17  # tokens or pairs worked on at a time
_U = np.uint64
_MASK = _U((1 << 48) - 1)
_M = _U(0x9E3779B97F4A7C15)
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if c in (9, 10, 11, 12, 13) else c for c in range(256))
END = 0xE0D0E0D0E0D0E0D1  # token hash of the end
START = 0x57A757A757A7  # context hash of the beginning

_SEEN: dict[bytes, int] = {}


def word_hash(word: bytes) -> int:
    h = _SEEN.get(word)
    if h is None:
        if len(_SEEN) > 150_000:
            _SEEN.clear()
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            _SEEN[word] = h
    return h


def tokens_of(data: bytes) -> np.ndarray:
    """Token hashes of a text with its end; read in blocks that end at blanks."""
    parts, at = [], 0
    while at < len(data):
        end = at + _BLOCK
        while end < len(data) and _LOWER[data[end]] != 32:
            end += 1
        parts.append(np.fromiter((word_hash(w) for w in data[at:end].translate(_LOWER).split(b" ") if w), np.uint64))
        at = end
    return np.concatenate([*parts, np.array([END], np.uint64)])


# --- dealing out ---------------------------------------------------------------------------
_SENT = {"slice": "int", "chunk": "bigint", "words": "binary", "lengths": "binary", "before": "binary", "owners": "binary", "meta": "binary"}
_TABLE = {"kind": "int", "key": "bigint", "other": "bigint", "n": "bigint", **{f"b{i}": "int" for i in range(1, K + 1)}, **{f"u{i}": "int" for i in range(1, K + 1)}, "known": "int", "unknown": "int", "x": "double", "y": "double", "z": "double"}
_KINDS = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
DOC, CONTEXT, UNLEARNED, STATS, META = range(5)
_TRAIN = 1 << 15


def _ddl(fields):
    return ", ".join(f"{k} {v}" for k, v in fields.items())


def _table(kind: int, size: int, **columns) -> pa.RecordBatch:
    """Rows of the slice tables; columns that a kind does not use are zero."""
    arrays = []
    for name, t in _TABLE.items():
        value = np.full(size, kind, np.int32) if name == "kind" else columns.get(name)
        arrays.append(pa.array(np.zeros(size, np.int64) if value is None else value).cast(_KINDS[t]))
    return pa.RecordBatch.from_arrays(arrays, names=list(_TABLE))


def _frequent(docs: DataFrame) -> np.ndarray:
    """Hashes of tokens to deal out further: all with a share of at least ``FREQUENT`` of the tokens of all texts.

    A batch names the tokens with half that share in it. What it leaves out of a
    token is less than half of ``FREQUENT`` of its own tokens, so the sums of a
    token frequent in all texts reach the other half.
    """

    def run(batches):
        for b in batches:
            words: Counter = Counter()
            for data in b.column("data"):
                words.update(w for w in data.as_py().translate(_LOWER).split(b" ") if w)
            size = words.total()
            top = [(word_hash(w), n) for w, n in words.items() if n >= size * FREQUENT / 2]
            hashes = np.array([0, *(h for h, _ in top)], np.uint64).view(np.int64)  # a row with no hash for the batch's size
            numbers = pa.array([size, *(n for _, n in top)], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(hashes, mask=np.arange(len(hashes)) == 0), numbers], names=["h", "n"])

    counts = docs.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).persist()
    try:
        total = counts.where("h is null").agg(F.sum("n")).first()[0] or 0
        rows = counts.where(F.col("h").isNotNull() & (F.col("n") >= max(2.0, total * FREQUENT / 2))).collect()  # at most 2 / FREQUENT
    finally:
        counts.unpersist()
    return np.unique(np.array([r["h"] & ((1 << 64) - 1) for r in rows] + [END], np.uint64))


def _count_frequent(docs: DataFrame, frequent: np.ndarray) -> dict[int, int]:
    """Exact training counts of the frequent tokens; a row per batch and token before the sum."""

    def run(batches):
        wanted = set(frequent.tolist())
        for b in batches:
            total: Counter = Counter()
            for data, train in zip(b.column("data"), b.column("train").to_pylist()):
                if train:
                    words = Counter(data.as_py().translate(_LOWER).split(b" "))
                    total[END] += 1
                    for w, n in words.items():
                        if w and (h := word_hash(w)) in wanted:
                            total[h] += n
            yield pa.RecordBatch.from_arrays([pa.array(np.array(list(total), np.uint64).view(np.int64)), pa.array(list(total.values()), pa.int64())], names=["h", "n"])

    rows = docs.mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).collect()  # at most 2 / FREQUENT + 1 rows
    return {r["h"] & ((1 << 64) - 1): r["n"] for r in rows}


def _where(word: np.ndarray, prior: np.ndarray, frequent: np.ndarray, slices: int) -> np.ndarray:
    """The slice of every token, in blocks."""
    out = np.empty(len(word), np.uint16 if slices <= 1 << 16 else np.uint32)
    for i in range(0, len(word), _TOKENS):
        w, p = word[i : i + _TOKENS], prior[i : i + _TOKENS]
        spread = frequent[np.minimum(np.searchsorted(frequent, w), len(frequent) - 1)] == w
        out[i : i + _TOKENS] = (np.where(spread, (w + p) * _M, w) >> _U(33)) % _U(slices)
    return out


def _send(docs: DataFrame, keys: list[int], frequent: np.ndarray) -> DataFrame:
    """Per batch of texts its tokens by slice, and one row about the texts."""
    slices = len(keys)

    def packed(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[t]) for c, t in zip(columns, _SENT.values())], names=list(_SENT))

    def run(batches):
        part = TaskContext.get().partitionId()
        for number, b in enumerate(batches):
            chunk = part << 20 | number
            train = b.column("train").to_numpy(zero_copy_only=False).astype(bool)
            words = []
            meta = np.zeros((b.num_rows, 4), np.int64)  # id, id is null, train, tokens
            meta[:, 0] = b.column("d").fill_null(0).to_numpy(zero_copy_only=False)
            meta[:, 1] = b.column("d").is_null().to_numpy(zero_copy_only=False)
            meta[:, 2] = train
            for i, data in enumerate(b.column("data")):
                t = tokens_of(data.as_py())
                meta[i, 3] = len(t)
                words.append(t)
            out, held = [[] for _ in _SENT], 0
            # a batch has a million tokens and more, so every array of them is dropped or overwritten as soon as it can be
            word = np.concatenate(words)
            words.clear()
            prior = np.empty_like(word)
            np.bitwise_and(word[:-1], _MASK, out=prior[1:])
            prior[np.cumsum(meta[:, 3]) - meta[:, 3]] = START
            owner = np.repeat(np.arange(b.num_rows, dtype=np.uint16) | np.where(train, _TRAIN, 0).astype(np.uint16), meta[:, 3])
            where = _where(word, prior, frequent, slices)
            order = np.lexsort((word, where))
            word, owner, where = word[order], owner[order], where[order]
            prior = prior[order]
            del order
            ends = np.searchsorted(where, np.arange(slices + 1))
            low = prior.view(np.uint8).reshape(-1, 8)[:, :6]  # 48 bits, little-endian
            for s in range(slices):
                a, z = ends[s], ends[s + 1]
                if z > a:
                    w = word[a:z]
                    first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1])))
                    lengths = np.diff(np.append(first, z - a)).astype(np.uint32)
                    for column, value in zip(out, (keys[s], chunk, w[first].tobytes(), lengths.tobytes(), low[a:z].tobytes(), owner[a:z].tobytes(), None)):
                        column.append(value)
                    held += z - a
                    if held >= _TOKENS:
                        yield packed(out)
                        out, held = [[] for _ in _SENT], 0
            for column, value in zip(out, (keys[chunk % slices], chunk, None, None, None, None, meta.tobytes())):
                column.append(value)
            yield packed(out)

    return docs.mapInArrow(run, _ddl(_SENT))


def _runs(*keys: np.ndarray) -> np.ndarray:
    change = np.zeros(len(keys[0]) - 1, bool)
    for k in keys:
        change |= k[1:] != k[:-1]
    return np.concatenate(([0], np.flatnonzero(change) + 1))


def _by_size(counts: np.ndarray, groups: np.ndarray, size: int) -> tuple[dict, np.ndarray]:
    """How many counts are 1..K in each group, and the discounted sum of the larger ones."""
    exact = [np.bincount(groups[counts == r], minlength=size) for r in range(1, K + 1)]
    large = counts > K
    return exact, np.bincount(groups[large], counts[large] - KEPT, size)


def _count(sent: DataFrame, slices: int, frequent: dict[int, int]) -> DataFrame:
    """The slice tables."""
    dealt = sent.repartition(slices, "slice")
    names = np.array(sorted(frequent), np.uint64)
    totals = np.array([frequent[int(n)] for n in names], np.int64)

    def counted(held):
        # a slice has more than a million tokens: arrays of them all are few and go as soon as they can, the rest is done in blocks
        chunks = np.array([h[0] for h in held], np.int64)
        size = [len(h[4]) // 2 for h in held]
        word = np.concatenate([np.repeat(np.frombuffer(h[1], np.uint64), np.frombuffer(h[2], np.uint32)) for h in held])
        raw = np.zeros((len(word), 8), np.uint8)
        ref, train = np.empty(len(word), np.int32 if len(held) < 1 << 16 else np.int64), np.empty(len(word), bool)
        for i, (h, end) in enumerate(zip(held, np.cumsum(size))):
            here = slice(end - size[i], end)
            owner = np.frombuffer(h[4], np.uint16)
            raw[here, :6] = np.frombuffer(h[3], np.uint8).reshape(-1, 6)
            ref[here], train[here] = (owner & (_TRAIN - 1)) + ref.dtype.type(i * _TRAIN), owner >= _TRAIN
            held[i] = None
        held.clear()
        prior = raw.view(np.uint64).ravel()
        order = np.lexsort((prior, word))
        word = word[order]
        prior = prior[order]
        ref = ref[order]
        train = train[order]
        del raw, order
        pair_start, word_start = _runs(word, prior), _runs(word)
        pair_count = np.add.reduceat(train, pair_start, dtype=np.int64)
        word_count = np.add.reduceat(train, word_start, dtype=np.int64)
        names_here = word[word_start]
        before = prior[pair_start]
        del word, prior, train
        at = np.minimum(np.searchsorted(names, names_here), max(len(names) - 1, 0))
        spread = names[at] == names_here if len(names) else np.zeros(len(names_here), bool)
        word_count = np.where(spread, totals[at] if len(names) else 0, word_count)
        # statistics; the frequent tokens are added once, elsewhere
        whole = word_count[~spread]
        stats = {0: whole.sum(), 1: (whole > 0).sum(), **{10 + r: (whole == r).sum() for r in range(1, K + 2)}, **{20 + r: (pair_count == r).sum() for r in range(1, K + 2)}}
        yield _table(STATS, len(stats), key=np.array(list(stats)), n=np.array(list(stats.values())))
        of_word = np.searchsorted(word_start, pair_start, "right") - 1
        # contexts, by the word before; one that is cut by a block has two rows
        learned = np.flatnonzero(pair_count)
        learned = learned[np.argsort(before[learned], kind="stable")]
        for i in range(0, len(learned), _TOKENS):
            pairs = learned[i : i + _TOKENS]
            context, c, cw = before[pairs], pair_count[pairs], word_count[of_word[pairs]]
            start = _runs(context)
            group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(context))))
            b, large = _by_size(c, group, len(start))
            u, common = _by_size(cw, group, len(start))
            columns = {f"b{r + 1}": b[r] for r in range(K)} | {f"u{r + 1}": u[r] for r in range(K)}
            yield _table(CONTEXT, len(start), key=context[start].view(np.int64), n=np.add.reduceat(c, start), x=large, y=common, **columns)
        del learned
        # documents and the pairs of theirs that were not learned; a document that is cut by a block has two rows
        pair = np.repeat(np.arange(len(pair_start), dtype=np.int32 if len(pair_start) < 1 << 31 else np.int64), np.diff(np.append(pair_start, len(ref))))
        del pair_start
        order = np.argsort(ref, kind="stable")
        log = lambda v: np.log10(np.maximum(v, 1e-9))
        for i in range(0, len(order), _TOKENS):
            here = order[i : i + _TOKENS]
            pairs, number = pair[here], chunks[ref[here] // _TRAIN] * _TRAIN + ref[here] % _TRAIN
            pc, wc, last = pair_count[pairs], word_count[of_word[pairs]], names_here[of_word[pairs]] == _U(END)
            start = _runs(number)
            n = len(start)
            slot = np.repeat(np.arange(n), np.diff(np.append(start, len(here))))
            total = lambda mask, value=None: np.bincount(slot[mask], None if value is None else value[mask], n)  # noqa: B023, E731
            known, new = wc > 0, pc == 0
            b, _ = _by_size(pc, slot, n)
            u, _ = _by_size(wc[new], slot[new], n)
            x = total(pc > K, log(pc - KEPT)) + total(new & (wc > K), log(wc - KEPT)) - total(known & ~last, log(wc))
            columns = {f"b{r + 1}": b[r] for r in range(K)} | {f"u{r + 1}": u[r] for r in range(K)}
            yield _table(DOC, n, key=number[start], n=total(known), x=x, y=total(known, np.log10(wc + 1.0)), known=total(new & known), unknown=total(new & ~known), **columns)
            yield _table(UNLEARNED, int(new.sum()), key=before[pairs[new]].view(np.int64), other=number[new])

    def run(batches):
        held: dict[int, list] = {}  # a partition has one slice, or more where slices outnumber partitions
        for b in batches:
            for number, chunk, words, lengths, before, owners, meta in zip(*(b.column(i).to_pylist() for i in range(7))):
                if meta is not None:
                    m = np.frombuffer(meta, np.int64).reshape(-1, 4)
                    yield _table(META, len(m), key=chunk * _TRAIN + np.arange(len(m)), other=m[:, 0], b1=m[:, 1], b2=m[:, 2], n=m[:, 3])
                    continue
                held.setdefault(number, []).append((chunk, words, lengths, before, owners))
        while held:
            yield from counted(held.popitem()[1])

    return dealt.mapInArrow(run, _ddl(_TABLE))


# --- discounts and scores ------------------------------------------------------------------
def discounts(n: dict[int, int], k: int = K) -> list[float]:
    """Katz's Good-Turing factor of counts 1..k from counts of counts (1..k+1).

    Where it is undefined or outside (0, 1) half a count is taken instead.
    """
    out = []
    share = (k + 1) * n.get(k + 1, 0) / n[1] if n.get(1) else 1.0
    for r in range(1, k + 1):
        value = -1.0
        if n.get(r) and n.get(r + 1) and share < 1:
            value = ((r + 1) * n[r + 1] / (r * n[r]) - share) / (1 - share)
        out.append(value if 0 < value < 1 else 1 - 0.5 / r)
    return out


def _stored(tables: DataFrame) -> DataFrame:
    """Write the slice tables to the shared folder, partitioned by kind, and read them back."""
    spark = tables.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/ngrams-{uuid.uuid4().hex}"
    tables.write.partitionBy("kind").parquet(folder)
    return spark.read.schema(tables.schema).parquet(folder)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", train: Column | None = None, slices: int | None = None) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text.

    ``train`` marks the rows to learn from (default: all).
    """
    spark = prepare(docs.sparkSession)
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    data = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    base = docs.select(F.col(f"`{key}`").cast("bigint").alias("d"), (F.lit(True) if train is None else F.coalesce(train, F.lit(False))).alias("train"), data.alias("data"))
    frequent = _frequent(base)
    counts = {int(h): 0 for h in frequent} | _count_frequent(base, frequent)
    tables = _stored(_count(_send(base, even_keys(spark, slices), frequent), slices, counts))

    stats = {r["key"]: r["n"] for r in tables.where(f"kind = {STATS}").groupBy("key").agg(F.sum("n").alias("n")).collect()}
    for c in counts.values():
        stats[0] = stats.get(0, 0) + c
        stats[1] = stats.get(1, 0) + (c > 0)
        if 1 <= c <= K + 1:
            stats[10 + c] = stats.get(10 + c, 0) + 1
    total, distinct = stats.get(0, 0), stats.get(1, 0)
    texts = counts.get(END, 0)
    du = discounts({r: stats.get(10 + r, 0) for r in range(1, K + 2)})
    db = discounts({r: stats.get(20 + r, 0) for r in range(1, K + 2)})
    # mass left to an unknown token: what the discounts take from all counts
    taken = sum((1 - d) * r * stats.get(10 + r, 0) for r, d in zip(range(1, K + 1), du)) + KEPT * (distinct - sum(stats.get(10 + r, 0) for r in range(1, K + 1)))
    unknown = taken / total if total else 1.0

    def weighted(prefix: str, factors: list[float]) -> Column:
        out = F.lit(0.0)
        for r, d in zip(range(1, K + 1), factors):
            out = out + F.col(f"{prefix}{r}") * F.lit(d)
        return out

    logs = lambda ds: [math.log10(d * r) for r, d in zip(range(1, K + 1), ds)]
    direct = weighted("b", logs(db)) + weighted("u", logs(du)) + F.col("x") - F.col("known") * F.lit(math.log10(max(total, 1))) + F.col("unknown") * F.lit(math.log10(unknown))
    none = F.lit(None)
    parts = tables.where(f"kind = {DOC}").select("key", "n", F.col("y").alias("base"), direct.alias("score"), none.cast("bigint").alias("d"), none.cast("bigint").alias("tokens"), none.cast("boolean").alias("learned"))

    mass = lambda ds: [d * r for r, d in zip(range(1, K + 1), ds)]
    contexts = tables.where(f"kind = {CONTEXT}").select("key", "n", (weighted("b", mass(db)) + F.col("x")).alias("kept"), (weighted("u", mass(du)) + F.col("y")).alias("follow"))
    contexts = contexts.groupBy("key").agg(F.sum("n").alias("c"), F.sum("kept").alias("kept"), F.sum("follow").alias("follow"))
    # log of backoff weight times the context's count
    left = (F.col("c") - F.col("kept")) / (1 - F.col("follow") / F.lit(float(max(total, 1))))
    weights = contexts.select("key", F.log10(left).alias("weight"))
    missed = tables.where(f"kind = {UNLEARNED}").groupBy("key", "other").agg(F.count(F.lit(1)).alias("n"))
    backed = missed.join(weights, "key").select(F.col("other").alias("key"), F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("base"), (F.col("n") * F.col("weight")).alias("score"), none.cast("bigint").alias("d"), none.cast("bigint").alias("tokens"), none.cast("boolean").alias("learned"))
    about = tables.where(f"kind = {META}").select(
        "key", F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("base"), F.lit(0.0).alias("score"), F.when(F.col("b1") == 0, F.col("other")).alias("d"), F.col("n").alias("tokens"), (F.col("b2") == 1).alias("learned")
    )
    summed = parts.unionByName(backed).unionByName(about).groupBy("key").agg(
        F.max("d").alias(key), (~F.max("learned")).alias("held_out"), F.max("tokens").alias("n_tokens"), F.sum("n").alias("n_known"), F.sum("base").alias("base"), F.sum("score").alias("score")
    )
    start = math.log10(texts) if texts else 0.0
    return summed.select(
        key,
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(math.log10(total + distinct + 1))).alias("base_score"),
        (F.col("score") - F.lit(start)).alias("score"),
    )
