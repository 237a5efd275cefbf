"""Benchmark decontamination: a broadcast set of normalised test n-grams.

Texts are lower-cased (A-Z only) and cut into words of ASCII letters and
digits and of any non-ASCII characters. A window is ``width`` consecutive words
of a benchmark item; a shorter item is one window. Every occurrence of a window
in a document marks its words as hit.

While the benchmark has at most ``max_windows`` windows their set is broadcast
and documents are scanned in place, without a shuffle. A larger benchmark is
joined with the windows of the documents instead; both ways give equal rows.

Defined cases: null and empty texts have no words and no hits; an item without
words has no window; items with a null id mark words but are not listed; equal
items are all listed; repeated documents are judged row by row; empty tables
give no rows or no hits; other columns of either table are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.common import cut_lineage, per_text, prepare

WIDTH = 10
MAX_WINDOWS = 500_000
_BLOCK = 1 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: bytes of words stay (A-Z lower-cased), all other bytes become blanks
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def split_words(data: bytes) -> Iterator[list[bytes]]:
    """Normalised words of a text, in blocks so that a huge text needs little memory."""
    at, size = 0, len(data)
    while at < size:
        end = at + _BLOCK
        if end < size:
            while end < size and _TABLE[data[end]] != 32:
                end += 1
        yield data[at:end].translate(_TABLE).split()
        at = end


def _words(text: Column) -> Column:
    """The same words as a column expression."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _GAPS), lambda w: w != "")


def windows(items: DataFrame, item: str = "item_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """(window array<string>, item_ids array<string>), one row per distinct window."""
    words = items.select(F.col(item).cast("string").alias("item"), _words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (width - 1)))
    each = words.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, width))).alias("window"))
    return each.groupBy("window").agg(F.collect_set("item").alias("item_ids"))


def _scanner(rows: list[tuple[list[str], list[str]]]) -> Callable:
    """Matcher over the broadcast windows, exact: words become numbers, windows tuples of them."""
    vocab: dict[bytes, int] = {}
    table: dict[int, dict[tuple, tuple]] = {}
    for window, ids in rows:
        key = tuple(vocab.setdefault(w.encode(), len(vocab) + 1) for w in window)
        table.setdefault(len(key), {})[key] = tuple(ids)
    get = vocab.get

    def scan(texts: list[bytes | None]) -> list[tuple[np.ndarray, set]]:
        """Per text: hit flag of each word and the items found."""
        parts, ends, at = [], [], 0
        for data in texts:
            for words in split_words(data or b""):
                parts.append(np.fromiter((get(w, 0) for w in words), np.int32, len(words)))
                at += len(words)
            ends.append(at)
            parts.append(np.zeros(1, np.int32))  # no window crosses from one text to the next
            at += 1
        codes = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        unknown = np.concatenate(([0], np.cumsum(codes == 0)))
        hit = np.zeros(len(codes), bool)
        found: list[set] = [set() for _ in texts]
        bounds = np.array(ends)
        for width, known in table.items():
            starts = np.flatnonzero(unknown[width:] == unknown[:-width]) if len(codes) >= width else ()
            for i in starts:
                ids = known.get(tuple(codes[i : i + width].tolist()))
                if ids is not None:
                    hit[i : i + width] = True
                    found[int(np.searchsorted(bounds, i, "right"))].update(ids)
        first = [0, *[e + 1 for e in ends[:-1]]]
        return [(hit[a:b], f) for a, b, f in zip(first, ends, found)]

    return scan


def _digest(ids: set) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


_FIELDS = {"n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"}


def scan_documents(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    width: int = WIDTH,
    max_windows: int = MAX_WINDOWS,
    keep: list[str] | None = None,
) -> DataFrame:
    """Append n_words, n_hit, n_items, items_sha256 and contaminated to each document."""
    prepare(docs.sparkSession)
    known = windows(items, item, item_text, width)
    rows = known.limit(max_windows + 1).collect()  # at most max_windows + 1 rows
    if len(rows) > max_windows:
        return _scan_by_join(docs, known, text, width, keep)
    shared = docs.sparkSession.sparkContext.broadcast([(r["window"], r["item_ids"]) for r in rows])

    def make():
        scan = _scanner(shared.value)

        def work(texts):
            out = {k: [] for k in _FIELDS}
            for hit, ids in scan(texts):
                n = int(hit.sum())
                for k, v in zip(_FIELDS, (len(hit), n, len(ids), _digest(ids), n > 0)):
                    out[k].append(v)
            return out

        return work

    return per_text(docs, text, make, _FIELDS, keep)


def _hits_by_join(words: DataFrame, known: DataFrame, width: int) -> DataFrame:
    """(_row, at, n, item_ids) of every window found in the words of a row."""
    spots = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.lit(width)),
            lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.struct(i.alias("at"), n.alias("n")))).otherwise(
                F.array().cast("array<struct<at:int,n:int>>")
            ),
        )
    )
    lengths = {r["n"] for r in known.select(F.size("window").alias("n")).distinct().collect()}  # at most ``width`` values
    each = words.withColumn("s", F.explode(F.filter(spots, lambda s: s["n"].isin(*lengths) if lengths else F.lit(False))))
    each = each.select("_row", F.col("s.at").alias("at"), F.col("s.n").alias("n"), F.expr("slice(w, s.at, s.n)").alias("window"))
    return each.join(known, "window").select("_row", "at", "n", "item_ids")


def _scan_by_join(docs: DataFrame, known: DataFrame, text: str, width: int, keep: list[str] | None) -> DataFrame:
    """The same columns for a benchmark beyond the broadcast bound."""
    names = [c for c in (docs.columns if keep is None else keep) if c not in _FIELDS]
    kept = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)]
    base = cut_lineage(docs.select(*kept, F.col(f"`{text}`").cast("string").alias("_text"), F.monotonically_increasing_id().alias("_row")))
    words = base.select("_row", _words(F.col("_text")).alias("w"))
    hits = _hits_by_join(words, known, width)
    marked = hits.select("_row", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("p")).distinct().groupBy("_row").agg(F.count("p").alias("n_hit"))
    listed = hits.select("_row", F.explode("item_ids").alias("i")).distinct().groupBy("_row").agg(F.sort_array(F.collect_list("i")).alias("ids"))
    out = base.join(words.select("_row", F.size("w").cast("bigint").alias("n_words")), "_row").join(marked, "_row", "left").join(listed, "_row", "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return out.select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)],
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """Documents without any hit, all columns kept."""
    names = docs.columns
    flagged = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)])
    judged = scan_documents(flagged, items, f"_c{names.index(text)}", **options).where(~F.col("contaminated"))
    return judged.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)])


def remove_spans(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", width: int = WIDTH, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """All documents, with the hit words (and the gaps inside a run of them) cut out of ``text``.

    A null text stays null.
    """
    prepare(docs.sparkSession)
    known = windows(items, item, item_text, width)
    rows = known.limit(max_windows + 1).collect()
    if len(rows) > max_windows:
        return _cut_by_join(docs, known, text, width)
    shared = docs.sparkSession.sparkContext.broadcast([(r["window"], r["item_ids"]) for r in rows])

    def make():
        scan = _scanner(shared.value)

        def work(texts):
            return {text: [t if t is None else _cut(t, hit).decode("utf-8", "ignore") for t, (hit, _) in zip(texts, scan(texts))]}

        return work

    return per_text(docs, text, make, {text: "string"}).select(*docs.columns)


def _cut_by_join(docs: DataFrame, known: DataFrame, text: str, width: int) -> DataFrame:
    """The same for a benchmark beyond the broadcast bound."""
    names = docs.columns
    own = f"_c{names.index(text)}"
    base = cut_lineage(docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)], F.monotonically_increasing_id().alias("_row")))
    base = base.withColumn(own, F.col(own).cast("string"))
    hits = _hits_by_join(base.select("_row", _words(F.col(own)).alias("w")), known, width)
    places = hits.select("_row", F.explode(F.sequence("at", F.col("at") + F.col("n") - 1)).alias("p")).groupBy("_row").agg(F.collect_set("p").alias("places"))
    at = len(names)

    def run(batches):
        for b in batches:
            column = names.index(text)
            new = []
            for t, found in zip(b.column(column).to_pylist(), b.column(at).to_pylist()):
                if t is not None and found:
                    hit = np.zeros(max(found), bool)
                    hit[np.array(found) - 1] = True
                    t = _cut(t.encode(), hit).decode("utf-8", "ignore")
                new.append(t)
            kept = [pa.array(new, pa.string()) if i == column else c for i, c in enumerate(b.columns[:at])]
            yield pa.RecordBatch.from_arrays(kept, names=[f"_c{i}" for i in range(at)])

    joined = base.join(places, "_row", "left").select(*[f"_c{i}" for i in range(at)], "places")
    return joined.mapInArrow(run, joined.drop("places").schema).toDF(*names)


def _cut(data: bytes, hit: np.ndarray) -> bytes:
    if not hit.any():
        return data
    solid = np.frombuffer(data.translate(_TABLE), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], solid.astype(np.int8), [0])))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    run = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    out, at = [], 0
    for a, b in zip(np.flatnonzero(run == 1), np.flatnonzero(run == -1) - 1):
        out.append(data[at : starts[a]])
        at = stops[b]
    return b"".join([*out, data[at:]])
