"""Ranked lexical search of all items against all documents by dual trees.

Documents and items are vectors over terms: a document's coordinates are its
saturated term frequencies, an item's are its term weights, and a score is
their product. Both sides are put into hierarchies whose nodes hold the maximum
of every coordinate. The product of two nodes' maxima bounds all scores between
them, so if it is below the weakest k-th score of the items in the node, the
whole batch of pairs is left out, exactly. Pairs of nodes that remain are
opened on both sides, down to the leaves, where scores are computed.

How it runs: items are taken in blocks of about ``BLOCK_TERMS`` terms (a stated
query set, broadcast block by block). For a block, one scan of the documents
writes an index of the block's terms, from which the counts come; a second one
searches it. Every task builds trees over ``GROUP`` documents at a time, keeps
the k best per item, and begins with the k-th scores of a small part of the
index, which are lower bounds. The tasks' best rows are ranked at the end.

Scores are integers (see ``scores``); equal scores go by ascending id.

Defined cases: null or empty texts have no terms, do not count and are never
found; items without terms give no rows; every row of ``items`` is searched by
itself, repeated ids included; repeated documents are all ranked; a null
document id ranks behind all others of its score; ids are integers below
2^63 - 1; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.llm.common import cut_lineage, prepare
from lumenloom.llm.decontaminate import split_words

TOP = 10
BLOCK_TERMS = 20_000
GROUP = 4096  # documents per forest of a task
GROUP_POSTINGS = 2_000_000
DOC_LEAF, DOC_FAN, ITEM_LEAF, ITEM_FAN = 16, 8, 4, 4
_SEED_SHARE = 64
_SALTS = 64
_NO_ID = (1 << 63) - 1
_EXACT = 1 << 53  # integers up to here are exact as doubles


def weight(total: int, df: int) -> int:
    """Weight of a term found in ``df`` of ``total`` documents; never negative."""
    return math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))


def saturated(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's coordinate in a document whose length norm is ``m``."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def length_norm(n: int, total: int, length: int) -> int:
    return 10 + 90 * n * total // length


# --- index ---------------------------------------------------------------------------
def item_table(items: DataFrame, item: str, text: str) -> DataFrame:
    """(_row, item, terms): the distinct terms of each row of items, in a table of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted({t.decode() for words in split_words(x or b"") for t in words}) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.string()))], names=["_row", "terms"])

    base = cut_lineage(items.select(F.monotonically_increasing_id().alias("_row"), F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").cast("string").cast("binary").alias("text")))
    return base.select("_row", "item").join(base.select("_row", "text").mapInArrow(run, "_row bigint, terms array<string>"), "_row")


def index_documents(docs: DataFrame, terms: list[str], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, codes, tfs): length of each document and the frequencies of the given terms, by their position."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = {t.encode(): i for i, t in enumerate(shared.value)}.get
        size = max(1, len(shared.value))
        for batch in batches:
            lengths, keys = np.zeros(batch.num_rows, np.int64), [np.zeros(0, np.int64)]
            for i, data in enumerate(batch.column(1).to_pylist()):
                for words in split_words(data or b""):
                    codes = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
                    lengths[i] += len(words)
                    keys.append(codes[codes >= 0] + i * size)
            key, tf = np.unique(np.concatenate(keys), return_counts=True)
            ends = pa.array(np.searchsorted(key, np.arange(batch.num_rows + 1) * size), pa.int32())
            codes = pa.ListArray.from_arrays(ends, pa.array(key % size, pa.int32()))
            tfs = pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths), codes, tfs], names=["doc_id", "n", "codes", "tfs"])

    narrow = docs.select(F.col(f"`{doc}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, n bigint, codes array<int>, tfs array<int>")


def document_frequencies(index: DataFrame, size: int) -> np.ndarray:
    """Documents that hold each term; sums per task, then one row per term of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        found = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(df[found])], names=["code", "df"])

    rows = index.select("codes").mapInArrow(run, "code int, df bigint").groupBy("code").agg(F.sum("df").alias("df")).collect()
    out = np.zeros(size, np.int64)
    for r in rows:
        out[r["code"]] = r["df"]
    return out


# --- trees -----------------------------------------------------------------------------
def _levels(count: int, leaf: int, fan: int) -> list[int]:
    """Rows per node on each level, from the top one to the leaves."""
    sizes = [leaf]
    while sizes[0] * 4 < count:
        sizes.insert(0, sizes[0] * fan)
    return sizes


class Items:
    """Tree over a block of items; rows lie in tree order."""

    def __init__(self, terms: list[list[int]], weights: np.ndarray, df: np.ndarray, top: int, floor: dict[int, tuple[int, int]]):
        # items that share their commonest terms, as those of one language do, stand together
        self.order = sorted((i for i, codes in enumerate(terms) if codes), key=lambda i: sorted(terms[i], key=lambda c: (-df[c], c)))
        n = len(self.order)
        plain = np.zeros((n, max(1, len(weights))), np.int64)
        for at, i in enumerate(self.order):
            plain[at, terms[i]] = weights[terms[i]]
        self.exact = n == 0 or int(plain.sum(axis=1).max()) * 1_000_000 < _EXACT
        self.rows = plain.astype(np.float64) if self.exact else plain
        self.sizes = _levels(n, ITEM_LEAF, ITEM_FAN)
        self.nodes = [np.maximum.reduceat(self.rows, np.arange(0, n, size)) if n else self.rows for size in self.sizes]
        self.top = top
        self.scores = np.zeros((n, top), np.int64)  # best first
        self.ids = np.full((n, top), _NO_ID, np.int64)
        start = [floor.get(i, (0, _NO_ID)) for i in self.order]
        self.floor = np.array([s for s, _ in start], np.int64)
        self.floor_id = np.array([d for _, d in start], np.int64)

    def weakest(self) -> tuple[np.ndarray, np.ndarray]:
        """Score and id that a document must beat (or equal) for each item; scores of 0 never count."""
        own, own_id = self.scores[:, -1], self.ids[:, -1]
        behind = (self.floor > own) | ((self.floor == own) & (self.floor_id < own_id))
        return np.maximum(np.where(behind, self.floor, own), 1), np.where(behind, self.floor_id, own_id)

    def offer(self, at: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate((self.scores[at], scores)), np.concatenate((self.ids[at], ids))
        best = np.lexsort((ids, -scores))[: self.top]
        self.scores[at], self.ids[at] = scores[best], ids[best]


class Documents:
    """Tree over a group of documents given as postings (row, code, coordinate)."""

    def __init__(self, ids: np.ndarray, row: np.ndarray, code: np.ndarray, value: np.ndarray, weights: np.ndarray, width: int):
        n = len(ids)
        # documents that share their weightiest term stand together
        impact = weights[code] * value
        by_row = np.lexsort((code, -impact, row))
        first = by_row[np.flatnonzero(np.diff(row[by_row], prepend=-1))] if n else by_row
        lead, lead_impact = np.full(n, -1), np.zeros(n, np.int64)
        lead[row[first]], lead_impact[row[first]] = code[first], impact[first]
        order = np.lexsort((ids, -lead_impact, lead))
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.ids = ids[order]
        row = place[row]
        by_place = np.argsort(row, kind="stable")
        self.row, self.code, self.value = row[by_place], code[by_place], value[by_place]
        self.bounds = np.searchsorted(self.row, np.arange(0, n + DOC_LEAF, DOC_LEAF))
        self.sizes = _levels(n, DOC_LEAF, DOC_FAN)
        self.width = width
        self.nodes = [self._maxima(size, n) for size in self.sizes]
        self.least_id = np.minimum.reduceat(self.ids, np.arange(0, n, DOC_LEAF))

    def _maxima(self, size: int, n: int) -> np.ndarray:
        out = np.zeros(-(-n // size) * self.width, np.int64)
        key = self.row // size * self.width + self.code
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        if len(starts):
            out[key[starts]] = np.maximum.reduceat(self.value[order], starts)
        return out.reshape(-1, self.width)

    def leaf(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of a leaf's documents, its terms, and the coordinates (document x term)."""
        a, b = self.bounds[k], self.bounds[k + 1]
        ids = self.ids[k * DOC_LEAF : (k + 1) * DOC_LEAF]
        codes, column = np.unique(self.code[a:b], return_inverse=True)
        table = np.zeros((len(ids), len(codes)), np.int64)
        table[self.row[a:b] - k * DOC_LEAF, column] = self.value[a:b]
        return ids, codes, table


def _opened(nodes: np.ndarray, size: int, below: int, count: int) -> np.ndarray:
    """Flags of the nodes one level down that lie under the flagged ones."""
    return nodes[np.arange(-(-count // below)) * below // size]


def search(items: Items, docs: Documents) -> int:
    """Offer every document that can be among an item's best; returns the number of exact scores computed."""
    n_items, n_docs, computed = len(items.rows), len(docs.ids), 0
    if not n_items or not n_docs:
        return 0
    kind = np.float64 if items.exact else np.int64
    alive = np.ones((len(items.nodes[0]), len(docs.nodes[0])), bool)
    depth = max(len(items.sizes), len(docs.sizes))
    for level in range(depth):
        i, d = min(level, len(items.sizes) - 1), min(level, len(docs.sizes) - 1)
        need = np.minimum.reduceat(items.weakest()[0], np.arange(0, n_items, items.sizes[i]))
        a, b = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        bound = np.zeros(alive.shape, kind)
        bound[np.ix_(a, b)] = items.nodes[i][a] @ docs.nodes[d][b].astype(kind).T
        alive &= bound >= need[:, None]
        if level + 1 < depth:
            if i + 1 < len(items.sizes):
                alive = _opened(alive, items.sizes[i], items.sizes[i + 1], n_items)
            if d + 1 < len(docs.sizes):
                alive = _opened(alive.T, docs.sizes[d], docs.sizes[d + 1], n_docs).T
    # leaves with the highest bounds first, so that the weakest scores rise early
    leaves = np.flatnonzero(alive.any(axis=0))
    for k in leaves[np.argsort(-bound[:, leaves].max(axis=0), kind="stable")]:
        need, need_id = items.weakest()
        own = np.flatnonzero(np.repeat(alive[:, k], ITEM_LEAF)[:n_items])
        reach = items.rows[own] @ docs.nodes[-1][k].astype(kind)
        own = own[(reach > need[own]) | ((reach == need[own]) & (docs.least_id[k] <= need_id[own]))]
        if not len(own):
            continue
        ids, codes, table = docs.leaf(k)
        scores = (items.rows[np.ix_(own, codes)] @ table.T.astype(kind)).astype(np.int64)
        computed += scores.size
        for at, row in zip(own, scores):
            better = np.flatnonzero((row > need[at]) | ((row == need[at]) & (ids <= need_id[at])))
            if len(better):
                items.offer(at, row[better], ids[better])
    return computed


# --- on Spark ----------------------------------------------------------------------------
def _best_rows(index: DataFrame, block: dict, floor: dict[int, tuple[int, int]]) -> DataFrame:
    """(_row, doc_id, score): each task's best documents of every item of the block."""
    shared = index.sparkSession.sparkContext.broadcast(block | {"floor": floor})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = shared.value
        items = Items(b["terms"], b["weights"], b["df"], b["top"], b["floor"])
        held, size, postings = [], 0, 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            postings += len(batch.column(2).flatten())
            if size >= GROUP or postings >= GROUP_POSTINGS:
                search(items, _documents(held, b))
                held, size, postings = [], 0, 0
        if size:
            search(items, _documents(held, b))
        at, k = np.nonzero(items.scores)
        rows = np.array([b["rows"][i] for i in items.order], np.int64)
        ids = items.ids[at, k]
        yield pa.RecordBatch.from_arrays([pa.array(rows[at]), pa.array(ids, mask=ids == _NO_ID), pa.array(items.scores[at, k])], names=["_row", "doc_id", "score"])

    return index.where(F.size("codes") > 0).mapInArrow(run, "_row bigint, doc_id bigint, score bigint")


def _documents(held: list[pa.RecordBatch], block: dict) -> Documents:
    table = pa.Table.from_batches(held).combine_chunks()
    ids = table.column("doc_id").fill_null(_NO_ID).to_numpy()
    norms = np.array([length_norm(n, block["total"], block["length"]) for n in table.column("n").to_pylist()], np.int64)
    lists = table.column("codes").combine_chunks()
    code, tf = lists.flatten().to_numpy().astype(np.int64), table.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
    return Documents(ids, row, code, saturated(tf, norms[row]), block["weights"], max(1, len(block["weights"])))


def _ranked(best: DataFrame, top: int) -> DataFrame:
    """The ``top`` rows of each item, in two steps so that no task ranks what all tasks found."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = best.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("_row", "salt").orderBy(*order))).where(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("_row").orderBy(*order))).where(F.col("rank") <= top).drop("salt")


def rank_documents(
    docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", top: int = TOP, block_terms: int = BLOCK_TERMS
) -> DataFrame:
    """(item, rank, doc, score): the ``top`` documents of each item with a score above 0."""
    prepare(docs.sparkSession)
    wanted = cut_lineage(item_table(items, item, item_text).where(F.size("terms") > 0))
    blocks = -(-int(wanted.agg(F.sum(F.size("terms")).alias("n")).first()["n"] or 0) // block_terms) or 1
    found = None
    for k in range(blocks):
        chosen = wanted.where(F.pmod(F.xxhash64("_row"), F.lit(blocks)) == k).select("_row", "terms").collect()  # about block_terms terms
        part = _search_block(docs, chosen, doc, text, top)
        found = part if found is None else found.unionByName(part)
    return found.join(wanted.select("_row", "item"), "_row").select(F.col("item").alias(item), "rank", F.col("doc_id").alias(doc), "score")


def _search_block(docs: DataFrame, chosen: list, doc: str, text: str, top: int) -> DataFrame:
    terms = sorted({t for r in chosen for t in r["terms"]})
    code = {t: i for i, t in enumerate(terms)}
    index = cut_lineage(index_documents(docs, terms, doc, text))
    sums = index.where("n > 0").agg(F.count("*").alias("total"), F.sum("n").alias("length")).first()
    df = document_frequencies(index, len(terms))
    block = {
        "rows": [r["_row"] for r in chosen],
        "terms": [[code[t] for t in r["terms"]] for r in chosen],
        "weights": np.array([weight(sums["total"], int(x)) for x in df], np.int64),
        "df": df,
        "top": top,
        "total": sums["total"],
        "length": sums["length"] or 1,
    }
    # k-th scores in a part of the index: any document found there is a real one, so these are lower bounds
    place = {row: i for i, row in enumerate(block["rows"])}
    seeds = _ranked(_best_rows(index.where(F.pmod(F.xxhash64("doc_id"), F.lit(_SEED_SHARE)) == 0), block, {}), top)
    floor = {place[r["_row"]]: (r["score"], _NO_ID if r["doc_id"] is None else r["doc_id"]) for r in seeds.where(F.col("rank") == top).collect()}
    return _ranked(_best_rows(index, block, floor), top)
