"""Removal of repeated substrings by distributed prefix doubling.

A byte goes when a string of ``length`` bytes that covers it also starts
anywhere else. Positions get ranks of growing length: the rank of ``2 m`` bytes
is made from the ranks of ``m`` bytes at a position and ``m`` further on. Spark
sorts (rank, position) pairs; unique positions drop out, the others are ranked
anew at a longer length until unique or past the threshold:

1. Each string of ``length`` bytes is represented by one position inside it, the
   smallest 16-byte rank among its first ``reach`` positions (the rightmost on
   ties). Equal strings have their representative at equal places, so only
   representatives are sorted, by the rank of the bytes that every string of
   theirs holds in common. A representative alone in its rank drops out.
2. Those left are told apart by the rank of all bytes their strings may cover.
   Where two agree, all their strings repeat.
3. The others are resolved string by string, by 128-bit ranks of ``length`` bytes.

Ranks are hashes, so no rank has to be handed back to a text between rounds.
Steps 2 and 3 use 128 bits: 64 of the common part and 64 of the whole, then 128.

Defined cases: null counts as empty; texts shorter than ``length`` lose nothing;
copies, repeated rows and rows with equal or null ids each count as texts of
their own; matches never cross texts; extra columns are carried along or ignored.

A class of equal strings reaches the sort at most once from every batch of
texts: repeats inside a batch are settled there. A run of the sorted order is
read as a stream, so no group of equal ranks is held in memory.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.common import ARROW, cut_lineage, deflated, prepare

LENGTH = 200
_FIRST = 16  # bytes of the rank that picks representatives
_PIECE = 1 << 18

_U = np.uint64
_MULTIPLY = [
    [_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xD6E8FEB86659FD93)],
    [_U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB), _U(0x8EBC6AF09C88C6E3)],
]


def _start_ranks(which: int) -> np.ndarray:
    """Random-looking rank of each byte."""
    x = (np.arange(1, 257, dtype=np.uint64)) * _MULTIPLY[which][0]
    x ^= x >> _U(31)
    x *= _MULTIPLY[which][1]
    x ^= x >> _U(29)
    return x * _MULTIPLY[which][2]


_BYTES = [_start_ranks(0), _start_ranks(1)]


def _join(a: np.ndarray, b: np.ndarray, which: int) -> np.ndarray:
    """Rank of two neighbouring strings from their ranks."""
    with np.errstate(over="ignore"):
        h = a * _MULTIPLY[which][0]
        h += b
        h ^= h >> _U(32)
        h *= _MULTIPLY[which][1]
        h ^= h >> _U(29)
    return h


def ranks(data: np.ndarray, longest: int, which: int = 0) -> list[np.ndarray]:
    """Ranks of 1, 2, 4, ... bytes (up to ``longest``) at each position."""
    levels, size = [_BYTES[which][data]], 1
    while size * 2 <= longest and len(levels[-1]) > size:
        levels.append(_join(levels[-1][:-size], levels[-1][size:], which))
        size *= 2
    return levels


def rank_at(levels: list[np.ndarray], starts: np.ndarray, sizes, which: int = 0) -> np.ndarray:
    """Rank of ``sizes`` bytes at ``starts``: two overlapping ranks of the largest power of two within.

    Comparable among strings of equal size only.
    """
    sizes = np.broadcast_to(np.asarray(sizes, np.int64), starts.shape)
    out = np.zeros(len(starts), np.uint64)
    power = np.frexp(np.maximum(sizes, 1))[1] - 1
    for p in np.unique(power):
        at = np.flatnonzero(power == p)
        level = levels[p]
        out[at] = _join(level[starts[at]], level[starts[at] + sizes[at] - (1 << int(p))], which)
    return out


def _lowest(keys: np.ndarray, width: int) -> np.ndarray:
    done, low = 1, keys
    while done * 2 <= width:
        low = np.minimum(low[:-done], low[done:])
        done *= 2
    rest = width - done
    return low if rest == 0 else np.minimum(low[:-rest], low[rest:])


def reach_of(length: int) -> int:
    """Positions among which a string picks its representative."""
    return max(1, min(128, (length * 16) // 25))


def first_of(length: int) -> int:
    size = 1
    while size * 2 <= min(_FIRST, length - reach_of(length) + 1):
        size *= 2
    return size


def pieces(size: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(from, to, lo, hi): representatives in [from, to) need the bytes [lo, hi) only."""
    reach = reach_of(length)
    for at in range(0, size, _PIECE):
        end = min(size, at + _PIECE)
        yield at, end, max(0, at - 2 * reach), min(size, end + length + reach)


def representatives(data: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Per representative: place, first and last string of its own, and two ranks."""
    found = []
    reach, first = reach_of(length), first_of(length)
    for at, end, lo, hi in pieces(len(data), length):
        part = data[lo:hi]
        if len(part) < length:
            continue
        levels = ranks(part, length + reach)
        keys = levels[first.bit_length() - 1][: len(part) - length + reach]
        # rank first, then the rightmost place
        low = _lowest((keys & ~_U(0xFFFFF)) | (_U(0xFFFFF) - np.arange(len(keys), dtype=np.uint64)), reach)
        place = (_U(0xFFFFF) - (low & _U(0xFFFFF))).astype(np.int64)
        change = np.flatnonzero(place[1:] != place[:-1])
        starts, stops = np.concatenate(([0], change + 1)), np.concatenate((change, [len(place) - 1]))
        spot = place[starts]
        mine = (spot + lo >= at) & (spot + lo < end)
        starts, stops, spot = starts[mine], stops[mine], spot[mine]
        left = np.maximum(0, spot - (reach - 1))
        right = np.minimum(len(part), spot + length)
        common = rank_at(levels, spot, length - reach + 1)
        whole = rank_at(levels, left, right - left)
        # strings at the ends of a text cover less; that is part of the rank
        whole ^= ((spot - left) * 1024 + right - spot).astype(np.uint64) * _U(0xD6E8FEB86659FD93)
        found.append((spot + lo, starts + lo, stops + lo, common, whole))
    names = ("place", "first", "last", "common", "whole")
    if not found:
        return {n: np.zeros(0, np.uint64 if n in ("common", "whole") else np.int64) for n in names}
    return {n: np.concatenate(x) for n, x in zip(names, zip(*found))}


# --- rows between the rounds ---------------------------------------------------------
# place = position << 16 | (position - first) << 9 | (position - last) << 2 | kind
_PLAIN, _MANY, _SETTLED = 0, 1, 2
_RANKED = {"core": "bigint", "whole": "bigint", "k1": "bigint", "k2": "bigint", "place": "bigint"}
GROUP_ROWS = 50_000  # larger groups of equal common ranks are resolved by Spark, string by string
_BATCH_ROWS = 5_000
_FEW = 1_000  # contexts whose ranks are held at once


def _ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{k} {v}" for k, v in fields.items())


def _batch(fields: dict[str, str], columns: list) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[v]) for c, v in zip(columns, fields.values())], names=list(fields))


def _keyed(docs: DataFrame, text: str, keep: list[str] = ()) -> DataFrame:
    """128-bit key of each text, the text's bytes, whether it is null, and the kept columns (c0, c1, ...)."""
    data = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
    kept = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]
    return docs.select(F.xxhash64(data).alias("k1"), F.xxhash64(F.lit(7), data).alias("k2"), data.alias("data"), F.col(f"`{text}`").isNull().alias("none"), *kept)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _ranked(docs: DataFrame, text: str, length: int) -> DataFrame:
    """Rank-position rows of all texts; what repeats inside a batch is settled there."""

    def run(batches):
        for b in batches:
            texts: dict[tuple, list] = {}
            for k1, k2, data in zip(b.column("k1").to_pylist(), b.column("k2").to_pylist(), b.column("data").to_pylist()):
                if len(data) >= length:
                    texts.setdefault((k1, k2), [data, 0])[1] += 1
            parts = []
            for (k1, k2), (data, copies) in texts.items():
                r = representatives(np.frombuffer(data, np.uint8), length)
                place = r["place"] << 16 | (r["place"] - r["first"]) << 9 | (r["place"] - r["last"]) << 2
                n = len(place)
                parts.append((r["common"], r["whole"], np.full(n, k1), np.full(n, k2), place | (_MANY if copies > 1 else _PLAIN)))
            if not parts:
                continue
            core, whole, k1, k2, place = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((whole, core))
            core, whole, k1, k2, place = (x[order] for x in (core, whole, k1, k2, place))
            again = np.concatenate(([False], (core[1:] == core[:-1]) & (whole[1:] == whole[:-1])))
            next_again = np.append(again[1:], False)
            place[next_again & ~again] |= _MANY
            place[again] = place[again] & ~3 | _SETTLED
            core[again] = (k1[again] * 31 + place[again]).view(np.uint64) * _MULTIPLY[0][0]  # dealt out evenly
            yield _batch(_RANKED, [_signed(core), _signed(whole), k1, k2, place])

    return _keyed(docs, text).mapInArrow(run, _ddl(_RANKED))


_FOUND = {"open": "int", "core": "bigint", "k1": "bigint", "k2": "bigint", "place": "bigint"}


def _settle(ranked: DataFrame) -> DataFrame:
    """Drop unique ranks; settle classes that repeat; leave the rest open.

    Reads the rows in sorted order with one row in hand, so a group may have any size.
    """
    ordered = ranked.repartition("core").sortWithinPartitions("core", "whole")

    def run(batches):
        held = None  # the last row, which still lacks its successor
        before = (None, None, False)  # core and whole of the row before it; had its class another before it in the group?

        def judge(rows, nxt):
            """Output for rows whose successor is known."""
            nonlocal before
            core, whole, k1, k2, place = rows
            settled = (place & 3) == _SETTLED
            pc = np.concatenate(([before[0] if before[0] is not None else ~core[0]], core[:-1]))
            pw = np.concatenate(([before[1] if before[1] is not None else ~whole[0]], whole[:-1]))
            nc, nw = np.append(core[1:], nxt[0]), np.append(whole[1:], nxt[1])
            group_before, group_after = pc == core, nc == core
            class_before, class_after = group_before & (pw == whole), group_after & (nw == whole)
            starts = np.flatnonzero(~class_before)
            other = np.zeros(len(core), bool)  # another class stands before in the group
            owner = np.searchsorted(starts, np.arange(len(core)), "right") - 1
            inside = owner >= 0
            other[inside] = group_before[starts[owner[inside]]]
            other[~inside] = before[2]
            full = (class_before | class_after | ((place & 3) == _MANY)) & ~settled
            mixed = ~class_after & (other | group_after) & ~settled  # last row of its class, in a group of several
            before = (core[-1], whole[-1], bool(other[-1]))
            cover, open_ = np.flatnonzero(full | settled), np.flatnonzero(mixed)
            out = [np.concatenate((x[cover], x[open_])) for x in (core, k1, k2, place)]
            return _batch(_FOUND, [np.repeat([0, 1], [len(cover), len(open_)]), *out])

        for b in batches:
            rows = [b.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            if b.num_rows == 0:
                continue
            if held is not None:
                rows = [np.concatenate((h, r)) for h, r in zip(held, rows)]
            if len(rows[0]) > 1:
                yield judge([r[:-1] for r in rows], (rows[0][-1], rows[1][-1]))
            held = [r[-1:] for r in rows]
        if held is not None:
            yield judge(held, (~held[0][0], ~held[1][0]))

    return ordered.mapInArrow(run, _ddl(_FOUND))


_CONTEXT = {"core": "bigint", "k1": "bigint", "k2": "bigint", "place": "bigint", "data": "binary"}


def _contexts(docs: DataFrame, open_: DataFrame, text: str, length: int) -> DataFrame:
    """The bytes that the strings of each open representative cover."""
    wanted = open_.groupBy("k1", "k2").agg(F.collect_set(F.struct("core", "place")).alias("wanted"))
    joined = deflated(_keyed(docs, text)).join(wanted.hint("shuffle_hash"), ["k1", "k2"]).select("k1", "k2", "data", "wanted")

    def run(batches):
        seen = set()  # copies of a text speak once
        for b in batches:
            rows: list[list] = [[] for _ in _CONTEXT]
            for k1, k2, packed, wanted in zip(*(b.column(i).to_pylist() for i in range(4))):
                if (k1, k2) in seen:
                    continue
                seen.add((k1, k2))
                data = zlib.decompress(packed)
                for w in wanted:
                    spot = w["place"] >> 16
                    first, last = spot - (w["place"] >> 9 & 127), spot - (w["place"] >> 2 & 127)
                    for column, value in zip(rows, (w["core"], k1, k2, w["place"], data[first : last + length])):
                        column.append(value)
            if rows[0]:
                yield _batch(_CONTEXT, rows)

    return joined.mapInArrow(run, _ddl(_CONTEXT))


_RESOLVED = {"kind": "int", "h1": "bigint", "h2": "bigint", "k1": "bigint", "k2": "bigint", "span": "bigint"}
# span = first string << 8 | number of further strings


def _strings(rows: list[tuple], length: int):
    """(h1, h2, row, start) of every string of the given contexts, ranked a few contexts at a time."""
    parts = [_some_strings(rows[i : i + _FEW], length) for i in range(0, len(rows), _FEW)]
    h1, h2, owner, start = (list(x) for x in zip(*parts))
    return np.concatenate(h1), np.concatenate(h2), np.concatenate([o + i * _FEW for i, o in enumerate(owner)]), np.concatenate(start)


def _some_strings(rows: list[tuple], length: int):
    joined = np.frombuffer(b"".join(r[4] for r in rows), np.uint8)
    sizes = np.array([len(r[4]) for r in rows])
    counts = sizes - length + 1
    offsets = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(rows)), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = offsets[owner] + within
    h = [rank_at(ranks(joined, length, which), at, length, which) for which in (0, 1)]
    first = np.array([(r[3] >> 16) - (r[3] >> 9 & 127) for r in rows])
    return _signed(h[0]), _signed(h[1]), owner, first[owner] + within


def _resolve(contexts: DataFrame, length: int) -> DataFrame:
    """Which single strings of the open representatives repeat (kind 0).

    Groups of equal common ranks come whole; one of over ``GROUP_ROWS`` rows is
    given out string by string instead (kind 1).
    """
    ordered = contexts.repartition("core").sortWithinPartitions("core")
    limit = GROUP_ROWS

    def repeated(rows):
        h1, h2, owner, start = _strings(rows, length)
        order = np.lexsort((h2, h1))
        same = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
        hit = np.zeros(len(h1), bool)
        hit[order[1:][same]] = True
        hit[order[:-1][same]] = True
        # neighbouring strings of one representative become one span
        begin = hit & ~np.concatenate(([False], hit[:-1] & (owner[1:] == owner[:-1])))
        end = hit & ~np.concatenate((hit[1:] & (owner[1:] == owner[:-1]), [False]))
        a, z = np.flatnonzero(begin), np.flatnonzero(end)
        k1, k2 = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        zero = np.zeros(len(a), np.int64)
        return _batch(_RESOLVED, [zero.astype(np.int32), zero, zero, k1[owner[a]], k2[owner[a]], start[a] << 8 | (z - a)])

    def given_out(rows):
        h1, h2, owner, start = _strings(rows, length)
        k1, k2 = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        return _batch(_RESOLVED, [np.ones(len(h1), np.int32), h1, h2, k1[owner], k2[owner], start << 8])

    def run(batches):
        whole: list[tuple] = []  # finished groups
        group: list[tuple] = []
        large = False
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(5))):
                if group and row[0] != group[0][0]:
                    if large:
                        yield given_out(group)
                    else:
                        whole += group
                    group, large = [], False
                    if len(whole) >= _BATCH_ROWS:
                        yield repeated(whole)
                        whole = []
                group.append(row)
                if len(group) > limit:
                    yield given_out(group)
                    group, large = [row], True
                    # the row stays to name the group; giving it out twice is undone by distinct()
        if large:
            yield given_out(group)
        else:
            whole += group
        if whole:
            yield repeated(whole)

    return ordered.mapInArrow(run, _ddl(_RESOLVED))


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """(k1, k2, spans) of each text that holds repeated strings.

    ``k1, k2`` is the text's 128-bit key; a span is the first of a run of
    repeated strings << 8 | the number of further ones.
    """
    prepare(docs.sparkSession)
    found = cut_lineage(_settle(_ranked(docs, text, length)))
    resolved = cut_lineage(_resolve(_contexts(docs, found.where("open = 1"), text, length), length))
    spot, back = F.shiftright("place", 16), F.shiftright("place", 9).bitwiseAND(127)
    further = back - F.shiftright("place", 2).bitwiseAND(127)
    parts = found.where("open = 0").select("k1", "k2", F.shiftleft(spot - back, 8).bitwiseOR(further).alias("span"))
    parts = parts.unionByName(resolved.where("kind = 0").select("k1", "k2", "span"))
    single = resolved.where("kind = 1").select("h1", "h2", "k1", "k2", "span").distinct()
    if not single.isEmpty():
        twice = single.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        parts = parts.unionByName(single.join(twice, ["h1", "h2"], "left_semi").select("k1", "k2", "span"))
    return parts.groupBy("k1", "k2").agg(F.collect_set("span").alias("spans"))


def _cut(size: int, spans: list[int] | None, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal removed runs of a text."""
    if not spans:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = np.array(spans, np.int64)
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, s >> 8, 1)
    np.add.at(edge, (s >> 8) + (s & 255) + length, -1)
    gone = np.concatenate(([False], np.cumsum(edge)[:-1] > 0, [False]))
    return np.flatnonzero(gone[1:] & ~gone[:-1]), np.flatnonzero(~gone[1:] & gone[:-1])


def _with_spans(docs: DataFrame, text: str, length: int, keep: list[str], fields: dict[str, str], make) -> DataFrame:
    """Kept columns and those that ``make`` computes from a text (None if null), its runs' starts and ends."""
    spans = repeated_spans(docs, text, length)
    joined = deflated(_keyed(docs, text, keep)).join(spans, ["k1", "k2"], "left").drop("k1", "k2")
    schema = ", ".join([*[f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)], _ddl(fields)])

    def run(batches):
        for b in batches:
            out = {k: [] for k in fields}
            null = b.column("none").to_pylist()
            for packed, span, none in zip(b.column("data"), b.column("spans").to_pylist(), null):
                data = zlib.decompress(packed.as_py())
                for k, v in zip(fields, make(None if none else data, *_cut(len(data), span, length))):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays([*[b.column(f"c{i}") for i in range(len(keep))], *[pa.array(out[k], ARROW[v]) for k, v in fields.items()]], names=[*[f"c{i}" for i in range(len(keep))], *fields])

    out = joined.mapInArrow(run, schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *fields)


def removal_report(docs: DataFrame, text: str = "text", length: int = LENGTH, keep: list[str] | None = None) -> DataFrame:
    """Per row: kept columns, n_bytes, n_removed, n_spans, kept_sha256."""

    def make(data, starts, stops):
        kept = _join_kept(data or b"", starts, stops)
        return len(data or b""), int((stops - starts).sum()), len(starts), hashlib.sha256(kept).hexdigest()

    fields = {"n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
    return _with_spans(docs, text, length, [c for c in (keep if keep is not None else docs.columns) if c not in fields], fields, make)


def _join_kept(data: bytes, starts: np.ndarray, stops: np.ndarray) -> bytes:
    ends = [0, *stops.tolist()]
    return b"".join(data[a:b] for a, b in zip(ends, [*starts.tolist(), len(data)]))


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """All rows and columns, with the repeated bytes cut out of ``text``.

    A character that is only partly repeated stays whole; a null text stays null.
    """

    def make(data, starts, stops):
        if data is None or len(starts) == 0:
            return (None if data is None else data.decode("utf-8", "replace"),)
        inside = np.concatenate(((np.frombuffer(data, np.uint8) & 0xC0) == 0x80, [False]))  # byte within a character
        spans = []
        for a, b in zip(starts.tolist(), stops.tolist()):
            while a < b and inside[a]:
                a += 1
            while b > a and inside[b]:
                b -= 1
            spans.append((a, b))
        return (_join_kept(data, np.array([s for s, _ in spans]), np.array([e for _, e in spans])).decode("utf-8", "replace"),)

    others = [c for c in docs.columns if c != text]
    out = _with_spans(docs, text, length, others, {"_text": "string"}, make)
    return out.select(*[F.col("_text").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
