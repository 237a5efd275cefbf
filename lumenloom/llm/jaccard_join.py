"""N-gram Jaccard join with prefix filters under several global token orders.

A document is the set of its distinct ``n``-word shingles. Two sets link when
``den * |common| >= num * |all|``. Under any global order of tokens, linked sets
share a token among the first ``size - ceil(size * num / den) + 1`` of each. Two
orders are used, both rare tokens first but otherwise different. Sets that share
such tokens, directly or over others, form a candidate group of an order; a link
lies inside a group of both orders, so the groups are intersected before any set
is read for verification. Equal sets are one from the start.

Frequencies count all documents. Tokens go to slices of the key space, packed
per batch of documents, and only those seen twice come back. An order may rest
on any function of a token, so a key shared by two tokens costs candidates, not
correctness. Verification compares full sets of 64-bit shingle hashes.

Inside a group sets are compared by their differences from a reference set: if
the differences of two sets are small enough together they link, which one hub
settles for most; all others must share rare differences and are looked up by
them. So a large group of near copies needs neither all pairs nor rows for them.
A group beyond ``GROUP_TOKENS`` is cut into blocks and every two blocks meet.

Defined cases: null texts and texts without words have the empty set, size 0,
and link with nothing; with fewer than ``n`` words the sequence is one shingle;
repeated rows and rows with equal or null ids are documents of their own; a
component of null ids only has a null id; empty tables give no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.common import cut_lineage, deflated, even_keys, prepare
from lumenloom.operators.clustering import connected_components

WORDS, NUM, DEN = 3, 90, 100
GROUP_TOKENS = 4_000_000
_BLOCK = 1 << 20
_U = np.uint64
_M1, _M2, _M3 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xD6E8FEB86659FD93)

_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if c in (9, 10, 11, 12, 13) else c for c in range(256))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(31))
    h *= _M3
    h ^= h >> _U(29)
    h *= _M2
    return h ^ (h >> _U(32))


_SEEN: dict[bytes, int] = {}


def _word_hash(word: bytes) -> int:
    h = _SEEN.get(word)
    if h is None:
        if len(_SEEN) > 150_000:
            _SEEN.clear()
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(word) <= 64:
            _SEEN[word] = h
    return h


def word_hashes(data: bytes) -> np.ndarray:
    """Hash of each word, in order; blocks end at blanks, so a huge text needs little memory."""
    parts, at = [], 0
    while at < len(data):
        end = at + _BLOCK
        while end < len(data) and _LOWER[data[end]] != 32:
            end += 1
        words = data[at:end].translate(_LOWER).split(b" ")
        parts.append(np.fromiter((_word_hash(w) for w in words if w), np.uint64))
        at = end
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingles(data: bytes | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    words = word_hashes(data or b"")
    if len(words) == 0:
        return words
    k = min(n, len(words))
    h = np.full(len(words) - k + 1, k, np.uint64) * _M1
    for i in range(k):
        h = _mix(h * _M1 + words[i : len(words) - k + 1 + i])
    return np.unique(h)


def _set_id(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _prefix_length(size, num: int, den: int):
    return size - (size * num + den - 1) // den + 1


# --- documents, slices of the token space, and back -----------------------------------
_SENT = {"slice": "int", "chunk": "bigint", "keys": "binary", "owners": "binary", "meta": "binary"}
_KINDS = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}


def _ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{k} {v}" for k, v in fields.items())


def _rows(fields: dict[str, str], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[v]) for c, v in zip(columns, fields.values())], names=list(fields))


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    data = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col(f"`{key}`").cast("bigint").alias("d"), F.xxhash64(data).alias("t1"), F.xxhash64(F.lit(7), data).alias("t2"), data.alias("data"))


def _send(docs: DataFrame, n: int, even: list[int]) -> DataFrame:
    """Per batch of documents: its token keys by slice, and one row about the documents."""
    slices = len(even)

    def run(batches):
        part = TaskContext.get().partitionId()
        for number, b in enumerate(batches):
            chunk = part << 24 | number
            ids = b.column("d")
            meta = np.zeros((b.num_rows, 6), np.int64)  # id, id is null, t1, t2, set, size
            meta[:, 0] = ids.fill_null(0).to_numpy(zero_copy_only=False)
            meta[:, 1] = ids.is_null().to_numpy(zero_copy_only=False)
            meta[:, 2], meta[:, 3] = b.column("t1").to_numpy(), b.column("t2").to_numpy()
            tokens, owners, known = [], [], {}
            for i, data in enumerate(b.column("data")):
                t = shingles(data.as_py(), n)
                meta[i, 5] = len(t)
                if len(t):
                    meta[i, 4] = _set_id(t)
                    if known.setdefault(int(meta[i, 4]), i) == i:  # equal sets of a batch speak once
                        tokens.append(t)
                        owners.append(np.full(len(t), i, np.uint16))
            out: list[list] = [[] for _ in _SENT]
            if tokens:
                every, owner = np.concatenate(tokens), np.concatenate(owners)
                where = (every >> _U(32)) % _U(slices)
                order = np.argsort(where, kind="stable")
                ends = np.searchsorted(where[order], np.arange(slices + 1))
                keys = (every & _U(0xFFFFFFFF)).astype(np.uint32)[order]
                owner = owner[order]
                for s in range(slices):
                    a, z = ends[s], ends[s + 1]
                    if z > a:
                        for column, value in zip(out, (even[s], chunk, keys[a:z].tobytes(), owner[a:z].tobytes(), None)):
                            column.append(value)
            for column, value in zip(out, (even[chunk % slices], chunk, None, None, meta.tobytes())):
                column.append(value)
            yield _rows(_SENT, out)

    return docs.mapInArrow(run, _ddl(_SENT))


_BACK = {"chunk": "bigint", "tokens": "binary", "owners": "binary", "often": "binary", "meta": "binary"}


def _count(sent: DataFrame, slices: int) -> DataFrame:
    """Tokens that more than one document has go back to their batches with their frequency."""
    ordered = sent.repartition(slices, "slice").sortWithinPartitions("slice")

    def counted(number, held):
        keys = [np.frombuffer(k, np.uint32) for _, k, _ in held]
        every = np.concatenate(keys)
        values, counts = np.unique(every, return_counts=True)
        more = counts >= 2
        values, counts = values[more], np.minimum(counts[more], 65535).astype(np.uint16)
        out: list[list] = [[] for _ in _BACK]
        for (chunk, _, owners), own in zip(held, keys):
            at = np.searchsorted(values, own)
            at[at == len(values)] = 0
            hit = np.flatnonzero(values[at] == own) if len(values) else np.zeros(0, np.int64)
            if len(hit):
                token = np.uint64(number & 0xFFFFFFFF) << _U(32) | own[hit].astype(np.uint64)
                row = (chunk, token.tobytes(), np.frombuffer(owners, np.uint16)[hit].tobytes(), counts[at[hit]].tobytes(), None)
                for column, value in zip(out, row):
                    column.append(value)
        return _rows(_BACK, out) if out[0] else None

    def run(batches):
        current, held = None, []
        for b in batches:
            about: list[list] = [[] for _ in _BACK]
            for number, chunk, keys, owners, meta in zip(*(b.column(i).to_pylist() for i in range(5))):
                if meta is not None:
                    for column, value in zip(about, (chunk, None, None, None, meta)):
                        column.append(value)
                    continue
                if number != current and held:
                    if (done := counted(current, held)) is not None:
                        yield done
                    held = []
                current = number
                held.append((chunk, keys, owners))
            if about[0]:
                yield _rows(_BACK, about)
        if held and (done := counted(current, held)) is not None:
            yield done

    return ordered.mapInArrow(run, _ddl(_BACK))


_JUDGED = {"d": "bigint", "t1": "bigint", "t2": "bigint", "sid": "bigint", "size": "bigint", "first": "array<bigint>", "second": "array<bigint>"}


def _prefixes(back: DataFrame, num: int, den: int) -> DataFrame:
    """One row per document: id, text key, set id, size and its shared prefix tokens under both orders."""
    ordered = back.repartition("chunk").sortWithinPartitions("chunk")

    def judged(held):
        meta = np.concatenate([np.frombuffer(m, np.int64).reshape(-1, 6) for *_, m in held if m is not None])
        rest = [h for h in held if h[3] is None]
        first: list = [None] * len(meta)
        second: list = [None] * len(meta)
        if rest:
            tokens = np.concatenate([np.frombuffer(h[0], np.uint64) for h in rest])
            owner = np.concatenate([np.frombuffer(h[1], np.uint16) for h in rest]).astype(np.int64)
            often = np.concatenate([np.frombuffer(h[2], np.uint16) for h in rest]).astype(np.int64)
            shared = np.bincount(owner, minlength=len(meta))
            # tokens that no other document has come first; what is left of the prefix is shared
            room = _prefix_length(meta[:, 5], num, den) - (meta[:, 5] - shared)
            mine = room[owner] > 0
            tokens, owner, often = tokens[mine], owner[mine], often[mine]
            for into, keys in ((first, (_mix(tokens), often)), (second, (_mix(tokens ^ _M1), np.frexp(often)[1]))):
                order = np.lexsort((*keys, owner))
                o, t = owner[order], tokens[order].view(np.int64)
                start = np.searchsorted(o, np.arange(len(meta) + 1))
                for i in np.unique(o):
                    into[i] = t[start[i] : min(start[i + 1], start[i] + room[i])]
        ids = pa.array(meta[:, 0], mask=meta[:, 1].astype(bool))
        sets = pa.array(meta[:, 4], mask=meta[:, 5] == 0)
        return pa.RecordBatch.from_arrays([ids, pa.array(meta[:, 2]), pa.array(meta[:, 3]), sets, pa.array(meta[:, 5]), pa.array(first, pa.list_(pa.int64())), pa.array(second, pa.list_(pa.int64()))], names=list(_JUDGED))

    def run(batches):
        current, held = None, []
        for b in batches:
            for chunk, *row in zip(*(b.column(i).to_pylist() for i in range(5))):
                if held and chunk != current:
                    yield judged(held)
                    held = []
                current = chunk
                held.append(row)
        if held:
            yield judged(held)

    return ordered.mapInArrow(run, _ddl(_JUDGED))


# --- candidate groups ---------------------------------------------------------------------
def _candidates(judged: DataFrame, tokens: str, out: str) -> DataFrame:
    """(sid, group) of the sets that share prefix tokens of one order, over others too."""
    rows = judged.where(F.col(tokens).isNotNull()).select("sid", F.explode(tokens).alias("token")).distinct()
    low = rows.groupBy("token").agg(F.min("sid").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    edges = rows.join(low, "token").where("sid <> low").select(F.col("low").alias("src"), F.col("sid").alias("dst"))
    return connected_components(edges).select(F.col("image_id").alias("sid"), F.col("component").alias(out))


# --- verification ----------------------------------------------------------------------------
def link_group(ids: list[int], sets: list[np.ndarray], num: int = NUM, den: int = DEN) -> dict[int, int]:
    """Smallest reachable id of each set of a group, by exact comparison.

    With ``x`` given by its difference ``D`` from a reference set, two sets link
    when ``f(x) + f(y) <= 2 (den + num) |D(x) & D(y)|``, where
    ``f = (den + num) |D| - (den - num) |x|``.
    """
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def union(a, b):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)

    some = sets[:256]
    values, counts = np.unique(np.concatenate(some), return_counts=True)
    reference = values[counts * 2 > len(some)]
    weight = den + num
    diffs = [np.setxor1d(s, reference, assume_unique=True) for s in sets]
    f = [weight * len(d) - (den - num) * len(s) for d, s in zip(diffs, sets)]
    hub = min(range(len(ids)), key=lambda i: f[i])
    rest = []
    for i in range(len(ids)):
        if f[i] + f[hub] <= 0:
            union(ids[i], ids[hub])
        elif i != hub:
            rest.append(i)
    if rest:
        # such a set links only over shared differences, looked up by rare ones
        often = Counter(t for d in diffs for t in d.tolist())
        as_sets = [set(d.tolist()) for d in diffs]
        lowest = min(f[i] for i in rest)

        def prefix(i, partner):
            need = max(1, -((f[i] + partner) // (-2 * weight)))
            return sorted(as_sets[i], key=lambda t: (often[t], t))[: max(0, len(as_sets[i]) - need + 1)]

        index: dict[int, list[int]] = {}
        for i in range(len(ids)):
            for t in prefix(i, lowest):
                if often[t] > 1:
                    index.setdefault(t, []).append(i)
        for y in rest:
            tried = {y}
            for t in prefix(y, f[hub]):
                for x in index.get(t, ()):
                    if x not in tried:
                        tried.add(x)
                        if root(ids[x]) != root(ids[y]) and f[x] + f[y] <= 2 * weight * len(as_sets[x] & as_sets[y]):
                            union(ids[x], ids[y])
    return {i: root(i) for i in ids}


_SETS = {"ca": "bigint", "cb": "bigint", "sid": "bigint", "tokens": "binary"}


def _read_sets(keyed: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """The shingle sets of the wanted texts (t1, t2, ca, cb, sid), each once per task."""
    joined = deflated(keyed.select("t1", "t2", "data")).join(wanted.hint("shuffle_hash"), ["t1", "t2"]).select("ca", "cb", "sid", "data")

    def run(batches):
        seen = set()
        for b in batches:
            out: list[list] = [[] for _ in _SETS]
            for ca, cb, sid, data in zip(*(b.column(i).to_pylist() for i in range(4))):
                if sid not in seen:
                    seen.add(sid)
                    for column, value in zip(out, (ca, cb, sid, shingles(zlib.decompress(data), n).tobytes())):
                        column.append(value)
            if out[0]:
                yield _rows(_SETS, out)

    return joined.mapInArrow(run, _ddl(_SETS))


def _verify(sets: DataFrame, sizes: DataFrame, num: int, den: int, limit: int) -> DataFrame:
    """(sid, root) of all sets of the groups."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("total") * 2 / limit)).cast("int")
    sized = sets.join(F.broadcast(sizes.select("ca", "cb", blocks.alias("blocks"))) if sizes.limit(20_001).count() <= 20_000 else sizes.select("ca", "cb", blocks.alias("blocks")), ["ca", "cb"])
    own = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    meets = sized.withColumn("own", own).withColumn("other", F.explode(other))
    dealt = meets.select("ca", "cb", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "sid", "tokens")
    ordered = dealt.repartition("ca", "cb", "a", "b").sortWithinPartitions("ca", "cb", "a", "b")

    def run(batches) -> Iterator[pa.RecordBatch]:
        current, ids, held = None, [], []

        def done():
            found = link_group(ids, held, num, den)
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["sid", "root"])

        for b in batches:
            for *group, sid, tokens in zip(*(b.column(i).to_pylist() for i in range(6))):
                if ids and group != current:
                    yield done()
                    ids, held = [], []
                current = group
                if sid not in ids[-1:]:
                    ids.append(sid)
                    held.append(np.frombuffer(tokens, np.uint64))
        if ids:
            yield done()

    found = ordered.mapInArrow(run, "sid bigint, root bigint")
    if sizes.where(F.col("total") * 2 > limit).isEmpty():
        return found.distinct()
    pairs = found.where("sid <> root").select(F.col("root").alias("src"), F.col("sid").alias("dst"))
    return connected_components(pairs).select(F.col("image_id").alias("sid"), F.col("component").alias("root"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = WORDS, num: int = NUM, den: int = DEN, slices: int | None = None, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """One row per document: d (its id), t1, t2 (key of its text), size, label.

    Documents of one component have one label; it is null for an empty set.
    """
    spark = prepare(docs.sparkSession)
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = _keyed(docs, key, text)
    judged = cut_lineage(_prefixes(_count(_send(keyed, n, even_keys(spark, slices)), slices), num, den))
    both = _candidates(judged, "first", "ca").join(_candidates(judged, "second", "cb"), "sid")
    about = judged.where("sid is not null").groupBy("sid").agg(F.min(F.struct("t1", "t2")).alias("t"), F.max("size").alias("size"))
    groups = cut_lineage(both.join(about, "sid").select("ca", "cb", "sid", "size", "t.t1", "t.t2"))
    sizes = groups.groupBy("ca", "cb").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("n")).where("n > 1")
    wanted = groups.join(sizes, ["ca", "cb"], "left_semi").select("t1", "t2", "ca", "cb", "sid")
    found = cut_lineage(_verify(_read_sets(keyed, wanted, n), sizes, num, den, group_tokens))
    return judged.select("d", "t1", "t2", "sid", "size").join(found, "sid", "left").select("d", "t1", "t2", "size", F.coalesce("root", "sid").alias("label"))


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, n_shingles, component_id) of every document."""
    found = cut_lineage(classes(docs, key, text, **options))
    low = found.where("label is not null").groupBy("label").agg(F.min("d").alias("low"))
    return found.join(low, "label", "left").select(
        F.col("d").alias(key), F.col("size").alias("n_shingles"), F.when(F.col("label").isNull(), F.col("d")).otherwise(F.col("low")).alias("component_id")
    )


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents with the smallest id of each component, all columns kept.

    Of rows alike in id and text one stays; documents without words all stay.
    """
    found = cut_lineage(classes(docs, key, text, **options))
    row = F.struct(F.col("d").isNull().alias("none"), F.coalesce("d", F.lit(0)).alias("id"), "t1", "t2")
    best = found.where("label is not null").groupBy("label").agg(F.min(row).alias("r")).select("r.*")
    names = docs.columns
    data = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    identity = {"none": F.col(f"`{key}`").isNull(), "id": F.coalesce(F.col(f"`{key}`").cast("bigint"), F.lit(0)), "t1": F.xxhash64(data), "t2": F.xxhash64(F.lit(7), data)}
    marked = docs.select(*[v.alias(k) for k, v in identity.items()], *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    kept = marked.join(best, ["none", "id", "t1", "t2"], "left_semi").dropDuplicates(["none", "id", "t1", "t2"])
    wordless = found.where("label is null").select(F.col("d").isNull().alias("none"), F.coalesce("d", F.lit(0)).alias("id"), "t1", "t2").distinct()
    out = kept.unionByName(marked.join(wordless, ["none", "id", "t1", "t2"], "left_semi"))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
