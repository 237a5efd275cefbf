"""Document fingerprints by winnowing.

Every run of ``k`` code points is hashed; of each ``window`` consecutive hashes
the smallest is selected, the rightmost one on ties. Texts that share a passage
of ``k + window - 1`` code points share a selected hash. Positions are kept, so
that a match can be traced to its place.

Defined cases: a null text counts as empty and selects nothing; a text shorter
than ``k`` is hashed whole, at position 0; a text with fewer than ``window``
hashes selects the smallest of them; equal texts get equal fingerprints; extra
columns are carried along or ignored. A huge text is read in overlapping pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.common import even_keys, per_text, prepare

K, WINDOW = 16, 64
_PIECE = 1 << 19
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= _M[3]
    h ^= h >> np.uint64(29)
    return h


def _rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """A 32-bit hash of every run of k codes, put together from runs of growing length."""
    out, done, block, size = None, 0, _mix((codes.astype(np.uint64) + np.uint64(1)) * _M[0]), 1
    n = len(codes) - k + 1
    while True:
        if k & size:
            part = block[done : done + n]
            out = part.copy() if out is None else _mix(out * _M[1] + part)
            done += size
        if size * 2 > k:
            return out >> np.uint64(32)
        block = _mix(block[:-size] * _M[2] + block[size:])
        size *= 2


def _smallest(keys: np.ndarray, window: int) -> np.ndarray:
    """Minimum of each window, by minima of growing width."""
    width, low = 1, keys
    while width * 2 <= window:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = window - width
    return low if rest == 0 else np.minimum(low[:-rest], low[rest:])


def fingerprint(codes: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes uint32, positions) selected from an array of code points, in text order."""
    if len(codes) == 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    k = min(k, len(codes))
    picked = []
    for at in range(0, len(codes) - k + 1, _PIECE):
        piece = codes[at : at + _PIECE + window + k - 2]
        if at and len(piece) < window + k - 1:
            break  # the piece before already has every window
        h = _rolling(piece, k)
        order = np.uint64(0xFFFFFFFF) - np.arange(len(h), dtype=np.uint64)  # rightmost first
        low = _smallest(h << np.uint64(32) | order, min(window, len(h)))
        low = low[np.concatenate(([True], low[1:] != low[:-1]))]
        picked.append((low >> np.uint64(32), (np.uint64(0xFFFFFFFF) - (low & np.uint64(0xFFFFFFFF))).astype(np.int64) + at))
    hashes, places = (np.concatenate(x) for x in zip(*picked))
    keep = np.concatenate(([True], places[1:] != places[:-1]))
    return hashes[keep].astype(np.uint32), places[keep]


def code_points(data: bytes | None) -> np.ndarray:
    text = (data or b"").decode("utf-8", "replace")
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sets of hashes (sorted, distinct); two empty ones are alike."""
    if len(a) == 0 and len(b) == 0:
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def fingerprints(docs: DataFrame, text: str = "text", k: int = K, window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """Append hashes (unsigned 32-bit in a bigint array) and positions (code points)."""

    def make():
        def work(texts):
            found = [fingerprint(code_points(t), k, window) for t in texts]
            return {"hashes": [h.astype(np.int64) for h, _ in found], "positions": [p.astype(np.int32) for _, p in found]}

        return work

    return per_text(docs, text, make, {"hashes": "array<bigint>", "positions": "array<int>"}, keep)


def _deal(docs: DataFrame, key: str, text: str, parts: int | None = None) -> DataFrame:
    """Rows (key, bytes, ghost) so that each partition holds a run of keys in order.

    The rows that open a run are also given, as ghosts, to the run before it (those
    of the first run to the last), so every row finds its successor at hand. Only
    one boundary per run is known to the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("bytes"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = rows.where("key is not null").approxQuantile("key", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    cuts = F.array(*[F.lit(int(b)) for b in sorted(set(bounds))]).cast("array<bigint>")
    run = F.coalesce(F.size(F.filter(cuts, lambda c: c <= F.col("key"))), F.lit(0))
    placed = rows.withColumn("run", F.when(F.col("key").isNull(), F.lit(0)).otherwise(run))
    # smallest key of each run that has rows; a null key sorts before all others
    nulls_first = F.struct(F.col("key").isNotNull().alias("has"), F.col("key"))
    heads = sorted((r["run"], r["low"]["key"]) for r in placed.groupBy("run").agg(F.min(nulls_first).alias("low")).collect())
    before, lows = [None] * parts, [None] * parts
    for i, (number, low) in enumerate(heads):
        before[number], lows[number] = heads[i - 1][0], low
    literal = lambda values, kind: F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")
    ghosts = placed.where(F.col("key").eqNullSafe(F.get(literal(lows, "bigint"), F.col("run")))).withColumn("run", F.get(literal(before, "int"), F.col("run")))
    both = placed.withColumn("ghost", F.lit(0)).unionByName(ghosts.withColumn("ghost", F.lit(1)))
    even = both.withColumn("run", F.get(literal(even_keys(spark, parts), "int"), F.col("run")))  # one run in each partition
    return even.repartition(parts, "run").sortWithinPartitions("run", "ghost", "key", "bytes")


_COMPARED = {
    "n_chars": pa.int64(),
    "edited_sha256": pa.string(),
    "fingerprint": pa.string(),
    "edited_fingerprint": pa.string(),
    "near_edited": pa.float64(),
    "near_next": pa.float64(),
    "n_selected": pa.int64(),
}


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """Fingerprint each text, its edited text and compare with the next document's.

    Rows are in ascending order of the key (null first), equal keys in order of
    their texts; the last is followed by the first. The edited text has its last
    quarter replaced by the beginning of the next text. The fingerprint strings
    hold the selected hashes in text order, eight hex digits each.
    """
    prepare(docs.sparkSession)
    dealt = _deal(docs, key, text)

    def written(hashes: np.ndarray) -> str:
        return hashes.astype(">u4").tobytes().hex()

    def judged(codes, own, nxt, nxt_set) -> list:
        hashes, own_set = own
        cut = len(codes) // 4
        edited = np.concatenate((codes[: len(codes) - cut], nxt[:cut])) if cut else codes
        again = fingerprint(edited, k, window)[0] if cut else hashes
        text = edited.tobytes().decode("utf-32-le")
        return [len(codes), hashlib.sha256(text.encode()).hexdigest(), written(hashes), written(again), likeness(own_set, np.unique(again)), likeness(own_set, nxt_set), len(hashes)]

    def run(batches) -> Iterator[pa.RecordBatch]:
        held = None  # the row that waits for its successor
        for b in batches:
            ids, rows = [], []
            keys, runs, ghosts = b.column("key").to_pylist(), b.column("run").to_pylist(), b.column("ghost").to_pylist()
            for i, data in enumerate(b.column("bytes")):
                if held is None and ghosts[i]:
                    continue
                codes = code_points(data.as_py())
                hashes = fingerprint(codes, k, window)[0]
                own = (hashes, np.unique(hashes))
                if held is not None:
                    ids.append(held[0])
                    rows.append(judged(held[1], held[2], codes, own[1]))
                held = None if ghosts[i] else (keys[i], codes, own)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c, v) for c, v in zip(zip(*rows), _COMPARED.values())]], names=[key, *_COMPARED])

    kinds = {pa.int64(): "bigint", pa.string(): "string", pa.float64(): "double"}
    return dealt.mapInArrow(run, f"`{key}` bigint, " + ", ".join(f"{n} {kinds[v]}" for n, v in _COMPARED.items()))
