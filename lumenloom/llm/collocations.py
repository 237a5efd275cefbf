"""Phrase collocations by prefix-free parsing.

Every text is parsed into chunks that start where a window of ``max_n - 1``
tokens hashes to a trigger and end with the next such window, so neighbours
overlap by just that window and equal passages give equal chunks wherever they
stand. The dictionary of distinct chunks carries how often each occurs in the
parse. N-grams are then counted inside the distinct chunks, weighted by that
frequency; an n-gram belongs to the chunk in whose own part (all but the
closing window) it begins, so the overlap is counted once. Phrases beyond two
words are counted only where both shorter phrases inside them may be frequent.

Texts are lower-cased (A-Z only), split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and
those at blanks and tabs into words; no phrase crosses a piece. All counts are
per language.

Defined cases: a null or empty text has no words; a null language is ``und``
(and counts together with a language of that name); repeated rows count each
time; ties in score go to the larger count, then the phrase in byte order;
empty tables give no rows; other columns are ignored. A text of any length is
parsed in blocks; where nothing triggers, a chunk is closed after ``LONGEST``
tokens, which costs repetition in the dictionary only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenloom.llm.common import cut_lineage, prepare

#: a trigger comes about once in so many tokens; more makes longer, rarer chunks
EVERY = 48
LONGEST = 4096
UNKNOWN = "und"
_BLOCK = 1 << 20
_HELD = 32 << 20  # bytes of chunks aggregated in a task before they are sent on
_TOKENS = 1 << 20  # tokens of distinct chunks counted together
_MEMO = 400_000
_HOT = 1000  # a part with over 1/1000 of all words is looked up by broadcast; there are at most 1000 per length
_SALTS = 64

_SLOTS = 1 << 21  # 64 bits each: 16 MB
_NAMES = ["key", "f"]  # a phrase, "\n" (which no word holds) and the language as one key, which is cheaper to group by than two

_STOP = b"."
#: A-Z lower-cased, piece ends become ".", blanks and tabs one blank; other bytes stay
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c in b" \t" else c for c in range(256))
_EDGE = re.compile(rb"[ \t.,;:!?\x0A-\x0D]")


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _blocks(data: bytes) -> Iterator[list[bytes]]:
    """Tokens of a text (words, and "." where a piece ends), in bounded blocks."""
    at, size = 0, len(data)
    while at < size:
        end = at + _BLOCK
        edge = _EDGE.search(data, end) if end < size else None
        end = edge.start() if edge else size
        yield data[at:end].translate(_TABLE).replace(_STOP, b" . ").split()  # no other white space that split() knows is left
        at = end


def parse(data: bytes, overlap: int, hashes: dict[bytes, int] | None = None) -> Iterator[list[bytes]]:
    """Chunks of one text as token lists; the last ``overlap`` tokens of each are the window that ends it."""
    hashes = _Hashes() if hashes is None else hashes
    held: list[bytes] = []
    for block in _blocks(data):
        held += block
        starts = _starts(held, overlap, hashes)
        for a, b in zip(starts, starts[1:]):
            yield held[a : b + overlap]
        held = held[starts[-1] :]
    held += [_STOP] * overlap  # the text's end closes the last chunk
    starts = _starts(held, overlap, hashes)
    ends = [*starts[1:], len(held) - overlap]
    yield from (held[a : b + overlap] for a, b in zip(starts, ends) if a < b)


def _starts(tokens: list[bytes], overlap: int, hashes: dict[bytes, int]) -> list[int]:
    """Where chunks start: 0, every window that triggers, and where one would grow too long."""
    h = np.fromiter(map(hashes.__getitem__, tokens), np.uint64, len(tokens))
    n = len(h) - overlap
    if n <= 1:
        return [0]
    mixed = np.zeros(n, np.uint64)
    for k in range(overlap):
        mixed = (mixed + h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    found = [0, *(np.flatnonzero(mixed[1:] % np.uint64(EVERY) == 0) + 1).tolist(), n]
    if max(np.diff(found)) > LONGEST:
        found = [x for a, b in zip(found, found[1:]) for x in range(a, b, LONGEST)] + [n]
    return found[:-1]


def dictionary(docs: DataFrame, text: str = "text", lang: str = "lang", max_n: int = 3) -> DataFrame:
    """(lang, chunk, freq): the distinct chunks of the parse and how often each occurs."""
    prepare(docs.sparkSession)
    overlap = max_n - 1
    language = F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNKNOWN))
    narrow = docs.select(language.alias("lang"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = _Hashes(), {}, 0
        for batch in batches:
            for language, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = held.setdefault(language, Counter())
                for chunk in parse(data or b"", overlap, hashes):
                    whole = b" ".join(chunk)
                    counts[whole] += 1
                    size += len(whole) + 100
                    if size >= _HELD:
                        yield from _chunk_rows(held)
                        held, size = {language: (counts := Counter())}, 0
        yield from _chunk_rows(held)

    each = narrow.mapInArrow(run, "lang string, chunk string, freq bigint")
    return each.groupBy("lang", "chunk").agg(F.sum("freq").alias("freq"))


def _chunk_rows(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
    for language, counts in held.items():
        chunks, freqs = list(counts), list(counts.values())
        for i in range(0, len(chunks), 20_000):
            part = pa.array(chunks[i : i + 20_000], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(part), pa.string()), part, pa.array(freqs[i : i + 20_000], pa.int64())], names=["lang", "chunk", "freq"])


def ngrams(chunks: DataFrame, max_n: int = 3, at_least: int = 1) -> DataFrame:
    """(lang, gram, f) of all n-grams of 1 to ``max_n`` words with f >= ``at_least``.

    The empty gram counts all words of a language, whatever ``at_least``.
    Beyond two words an n-gram is counted only if both n-grams one word shorter
    inside it may be frequent (none that is left out can be): a bit filter of
    fixed size tells, which errs only by letting some more through.
    """
    found = cut_lineage(_counted(chunks, max_n - 1, range(1, min(max_n, 2) + 1), None, at_least))
    for n in range(3, max_n + 1):
        bits = _frequent(found.where(F.size(F.split("gram", " ")) == n - 1))
        found = found.unionByName(cut_lineage(_counted(chunks, max_n - 1, range(n, n + 1), bits, at_least)))
    return found


def _counted(chunks: DataFrame, overlap: int, sizes: range, bits: np.ndarray | None, at_least: int) -> DataFrame:
    shared = chunks.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held()
        for batch in batches:
            held.add(batch)
            if held.size >= _TOKENS:
                yield from _count(held, overlap, sizes, shared.value)
                held = _Held()
        yield from _count(held, overlap, sizes, shared.value)

    # tasks have summed already; a second partial sum before the shuffle finds little more and costs much
    each = chunks.select("lang", "chunk", "freq").mapInArrow(run, "key string, f bigint").repartition("key")
    sums = each.groupBy("key").agg(F.sum("f").alias("f")).withColumn("gram", F.substring_index("key", "\n", 1))
    kept = sums.where((F.col("f") >= at_least) | (F.col("gram") == ""))
    return kept.select(F.expr("substring(key, length(gram) + 2)").alias("lang"), "gram", "f")


def _mix(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase with one more word."""
    h = (h + word) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(29)


def _bits(h: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The filter's places of a phrase: (slot, mask) each."""
    places = [h % np.uint64(64 * _SLOTS), (h >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(37)]
    return [((x // np.uint64(64)).astype(np.int64), np.uint64(1) << x % np.uint64(64)) for x in places]


def _frequent(grams: DataFrame) -> np.ndarray:
    """Bit filter of the given phrases; at most _SLOTS rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for i, (language, gram) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                h = np.array([xxhash.xxh3_64_intdigest(language)], np.uint64)
                for w in gram.split(" "):
                    h = _mix(h, np.uint64(xxhash.xxh3_64_intdigest(w)))
                out[i] = h[0]
            for slot, mask in _bits(out):
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(mask.astype(np.int64))], names=["slot", "mask"])

    rows = grams.select("lang", "gram").mapInArrow(run, "slot bigint, mask bigint").groupBy("slot").agg(F.expr("bit_or(mask)").alias("mask")).toArrow()
    bits = np.zeros(_SLOTS, np.uint64)
    bits[rows.column("slot").to_numpy()] = rows.column("mask").to_numpy().astype(np.uint64)
    return bits


class _Numbers(dict):
    """Numbers of names in the order in which they are first met."""

    def __missing__(self, name: str) -> int:
        number = self[name] = len(self)
        return number


class _Held:
    """Chunks waiting to be counted, as numbers of their words."""

    def __init__(self):
        self.words, self.languages = _Numbers({".": 0}), _Numbers()
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size = 0

    def add(self, batch: pa.RecordBatch) -> None:
        chunks = batch.column(1).to_pylist()
        if not chunks:
            return
        tokens = " ".join(chunks).split(" ")
        word = np.fromiter(map(self.words.__getitem__, tokens), np.int32, len(tokens))
        lengths = np.fromiter((c.count(" ") + 1 for c in chunks), np.int64, len(chunks))
        lang = np.fromiter(map(self.languages.__getitem__, batch.column(0).to_pylist()), np.int32, len(chunks))
        self.parts.append((word, lengths, lang, batch.column(2).to_numpy()))
        self.size += len(word)


def _count(held: _Held, overlap: int, sizes: range, bits: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """N-grams that begin in the chunks' own parts, summed with the chunks' frequencies."""
    if not held.size:
        return
    word, lengths, lang, freq = (np.concatenate(x) for x in zip(*held.parts))
    weight, lang = np.repeat(freq, lengths), np.repeat(lang, lengths).astype(np.int64)
    vocabulary, languages = held.words, held.languages
    own = np.ones(len(word), bool)
    for back in range(1, overlap + 1):
        own[np.cumsum(lengths) - back] = False
    at = np.flatnonzero(own & (word != 0))
    words, names = pa.array(list(vocabulary), pa.string()), pa.array(["\n" + x for x in languages], pa.string())
    if bits is None:
        totals = np.zeros(len(languages), np.int64)
        np.add.at(totals, lang[at], weight[at])
        yield pa.RecordBatch.from_arrays([names, pa.array(totals)], names=_NAMES)
    else:
        for k in range(1, sizes[0]):
            at = at[word[at + k] != 0]
        spread = np.array([xxhash.xxh3_64_intdigest(t) for t in vocabulary], np.uint64)
        start = np.array([xxhash.xxh3_64_intdigest(t) for t in languages], np.uint64)
        for shift in (0, 1):
            h = start[lang[at]]
            for k in range(sizes[0] - 1):
                h = _mix(h, spread[word[at + shift + k]])
            at = at[np.logical_and.reduce([bits[slot] & mask != 0 for slot, mask in _bits(h)])]

    key, span = lang[at], len(languages)  # grows by one word at a time
    for n in range(1, sizes[-1] + 1):
        inside = word[at + n - 1] != 0
        at, key = at[inside], key[inside]
        if not len(at):
            return
        if span * len(vocabulary) >= 1 << 62:  # kept dense, so that it fits 64 bits
            _, key = np.unique(key, return_inverse=True)
            span = len(key)
        key, span = key * len(vocabulary) + word[at + n - 1], span * len(vocabulary)
        if n not in sizes:
            continue
        order = np.argsort(key)
        starts = np.flatnonzero(np.diff(key[order], prepend=-1))
        first, sums = at[order[starts]], np.add.reduceat(weight[at][order], starts)
        gram = words.take(pa.array(word[first]))
        for k in range(1, n):
            gram = pc.binary_join_element_wise(gram, words.take(pa.array(word[first + k])), " ")
        rows = pa.RecordBatch.from_arrays([pc.binary_join_element_wise(gram, names.take(pa.array(lang[first])), ""), pa.array(sums)], names=_NAMES)
        yield from (rows.slice(i, 50_000) for i in range(0, rows.num_rows, 50_000))


def _look_up(df: DataFrame, part: str, counts: DataFrame, total: int, out: str) -> DataFrame:
    """Add the count of the phrase part; the few very frequent parts by broadcast, others by a join."""
    table = counts.select("lang", F.col("gram").alias(part), F.col("f").alias(out))
    hot = table.where(F.col(out) * _HOT > total)  # at most _HOT per length of phrase, since counts of a length sum to total or less
    cold = table.where(F.col(out) * _HOT <= total)
    tried = df.join(F.broadcast(hot), ["lang", part], "left")
    names = [*df.columns, out]
    return tried.where(F.col(out).isNotNull()).select(*names).unionByName(tried.where(F.col(out).isNull()).drop(out).join(cold, ["lang", part]).select(*names))


def _scores(cuts: DataFrame) -> DataFrame:
    """Add floor(1000000 f f / (l r)) in 38-digit integers, which hold it for counts below 10^16; beyond, Spark raises."""
    wide = {f"{c}19": F.col(c).cast("decimal(19,0)") for c in ("f", "l", "r")}
    return cuts.withColumns(wide).withColumn("score", F.expr("bigint((1000000BD * f19 * f19) div (l19 * r19))")).drop(*wide)


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", min_n: int = 2, max_n: int = 3, at_least: int = 10, covered: int = 50, top: int = 2000
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    ``a`` counts the phrase, ``l`` and ``r`` its parts at the cut with the lowest
    ``floor(1000000 a a / (l r))`` (the first such cut), ``n`` the language's
    words. A phrase goes when a longer one that holds it has ``covered`` percent
    of its count or more.
    """
    counts = ngrams(cut_lineage(dictionary(docs, text, lang, max_n), compression="zstd"), max_n, at_least)
    totals = counts.where("gram = ''").select("lang", F.col("f").alias("n"))
    total = totals.agg(F.sum("n").alias("n")).first()["n"] or 0
    counts = counts.where("gram <> ''")
    phrases = counts.withColumn("size", F.size(F.split("gram", " "))).where(F.col("size").between(min_n, max_n))

    # phrases inside longer ones: the largest count of any longer phrase around each
    spans = F.expr(
        f"flatten(transform(sequence({min_n}, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(split(gram, ' '), i, m), ' '))))"
    )
    inner = phrases.where(F.col("size") > min_n).select("lang", F.explode(spans).alias("gram"), F.col("f").alias("around"))
    inner = inner.groupBy("lang", "gram").agg(F.max("around").alias("around"))
    kept = phrases.join(inner, ["lang", "gram"], "left").where(F.col("around").isNull() | (100 * F.col("around") < covered * F.col("f"))).drop("around")

    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"first": F.expr("array_join(slice(split(gram, ' '), 1, k), ' ')"), "rest": F.expr("array_join(slice(split(gram, ' '), k + 1, size), ' ')")})
    cuts = _look_up(_look_up(cuts, "first", counts, total, "l"), "rest", counts, total, "r")
    cuts = _scores(cuts)
    lowest = cuts.groupBy("lang", "gram").agg(F.min(F.struct("score", "k", "l", "r", "f")).alias("m"))
    scored = lowest.select("lang", F.col("gram").alias("phrase"), F.col("m.f").alias("a"), "m.l", "m.r", "m.score")

    # bounded in two steps, so that no task sorts all phrases of a language
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    near = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top)
    best = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
