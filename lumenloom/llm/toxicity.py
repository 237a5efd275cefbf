"""Toxicity by a gap-weighted subsequence kernel, Nyström landmarks and a linear SVM.

Two words are compared by the subsequences of three characters they share, each
weighted by ``decay`` to the power of the stretch it covers, so gaps and inserted
characters lower the likeness but do not end it. Words with punctuation inside
are also read without it. A text is described by two numbers per landmark word:
the best likeness of its words, and the mean of the likenesses' third powers
with every repetition counted, on a log scale. No likeness is cut off; how far
the best one rises above what untoxic texts have is a number of its own. Nyström's
map turns these into features, on which a linear SVM is trained with class
weights, and a logistic curve turns its margin into a score.

Landmarks and SVM are fitted on a bounded sample of labelled texts; the model's
size depends on parameters only and is broadcast. Whole texts are scored without
a shuffle; words are judged once per worker while a bounded memo holds them.

Defined cases: null and empty texts have no words and get the score of a text
without any likeness; single characters set apart by blanks are read as one word
too; unlabelled rows teach nothing; with only one label learned all scores are
its share (0 without any); repeated rows are scored alike; extra columns are
carried along or ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.common import per_text, prepare

SAMPLE = 20_000  # expected bound of labelled texts used for fitting
LANDMARKS = 96
CANDIDATES = 4_000  # strings considered as landmarks
EVIDENCE = 6.0  # a landmark's excess among toxic texts, in standard deviations
STEMS = (4, 5, 6, 7, 8)  # lengths of word beginnings that may be landmarks
LONGEST = 24  # a word is compared by pieces of this many characters
STRETCH = 7  # longest stretch of a subsequence
POWER = 3  # of likenesses before they are averaged
ABOVE = 0.1  # rise of the best likeness over untoxic texts' that counts in full
RISE = 2.0  # weight of that rise among the features
USUAL = 0.95  # share of untoxic texts whose best likeness is no rise
DECAY = 0.6
PER = 200.0  # mean likeness m enters as log(1 + PER * m)
MEMO = 300_000
BLOCK = 20_000  # words of texts described at once

_ALPHABET = 64
_SPLIT = re.compile(r"[^\s.,;:!?\"()\[\]{}|]+")
_APART = re.compile(r"(?<!\S)(?:\S[^\w\s]*[ ]{1,3}){2,}\S(?=[^\w\s]*(?!\S))")
_BROKEN = re.compile(r"(?<![^\W_])[^\W_]++(?:(?:[^\w\s]|_)++[^\W_]++)+")
#: a text without a match of these has none of the two above, which cost more to look for
_MAY_APART = re.compile(r" \S[^\w\s]* {1,3}\S[^\w\s]*(?!\S)")
_MAY_BROKEN = re.compile(r"(?:[^\w\s]|_)[^\W_]")
_SIGNS = re.compile(r"[\W_]+")
_WIDE = LONGEST + 1
_TRIPLES = np.array([(i, j, k) for i in range(_WIDE) for j in range(i + 1, _WIDE) for k in range(j + 1, _WIDE) if k - i < STRETCH])
_TRIPLES = _TRIPLES[np.argsort(_TRIPLES[:, 2], kind="stable")]  # those of a short word come first
_SPAN = _TRIPLES[:, 2] - _TRIPLES[:, 0] + 1


def words_of(text: str) -> Counter[str]:
    """The words of a text and how often each occurs."""
    text = text.lower()
    words = Counter(_SPLIT.findall(text))
    for m in _APART.finditer(text) if _MAY_APART.search(text) else ():
        words[_SIGNS.sub("", m.group()) or m.group().replace(" ", "")] += 1
    for m in _BROKEN.finditer(text) if _MAY_BROKEN.search(text) else ():
        words[_SIGNS.sub("", m.group())] += 1
    return words


def _pieces(word: str) -> list[str]:
    """Overlapping pieces of a long word; none is left out."""
    if len(word) <= LONGEST:
        return [word]
    step = LONGEST // 2
    return [word[i : i + LONGEST] for i in range(0, len(word) - step, step)]


def _letters(words: list[str]) -> np.ndarray:
    """Character numbers: 63 for a word's beginning, 1-26 for a-z, 27-62 for all others, 0 beyond the end."""
    out = np.frombuffer("".join([w.ljust(LONGEST, "\0") for w in words]).encode("utf-32-le", "replace"), np.uint32).reshape(-1, LONGEST)
    latin = (out >= 97) & (out <= 122)
    numbers = np.where(out == 0, 0, np.where(latin, out - 96, 27 + out % (_ALPHABET - 28))).astype(np.uint32)
    return np.hstack((np.full((len(words), 1), _ALPHABET - 1, np.uint32), numbers))


def _subsequences(words: list[str]):
    """(codes, weights) of the 3-character subsequences of each word; code 0 where there is none."""
    size = int(np.searchsorted(_TRIPLES[:, 2], max(map(len, words), default=0), "right"))
    (i, j, k), c = _TRIPLES[:size].T, _letters(words)
    codes = (c[:, i] * _ALPHABET + c[:, j]) * _ALPHABET + c[:, k]
    return np.where(c[:, k] == 0, 0, codes), (DECAY ** _SPAN[:size]).astype(np.float32)


def _norms(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Length of each word's vector of subsequence weights."""
    if codes.shape[1] == 0:
        return np.zeros(len(codes))
    packed = np.sort(codes.astype(np.uint32) << np.uint32(12) | np.arange(codes.shape[1], dtype=np.uint32), axis=1)
    sorted_codes = packed >> np.uint32(12)
    w = np.where(sorted_codes > 0, weights[packed & np.uint32(4095)], 0).ravel()
    fresh = np.ones(packed.shape, bool)
    fresh[:, 1:] = sorted_codes[:, 1:] != sorted_codes[:, :-1]
    first = np.flatnonzero(fresh)
    sums = np.add.reduceat(w, first)
    return np.sqrt(np.bincount(first // packed.shape[1], sums * sums, len(codes)))


class Likeness:
    """Normalised kernel of words against fixed landmark words."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        codes, weights = _subsequences([w[:LONGEST] for w in landmarks])
        seen = np.unique(codes[codes > 0])
        self.feature = np.zeros(_ALPHABET**3, np.int32)
        self.feature[seen] = np.arange(1, len(seen) + 1)
        self.table = np.zeros((len(seen) + 1, len(landmarks)), np.float32)
        for i, row in enumerate(codes):
            np.add.at(self.table, (self.feature[row], i), weights)
        self.table[0] = 0
        length = np.sqrt((self.table**2).sum(axis=0))
        self.table /= np.where(length > 0, length, 1)
        # one copy of the table for each stretch, weighted by it, so that a subsequence is one row to be added
        spans, self.copy = np.unique(_SPAN, return_inverse=True)
        self.weighted = np.concatenate([self.table * np.float32(DECAY**s) for s in spans])

    def __call__(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        order = np.argsort([len(w) for w in words], kind="stable")
        for at in range(0, len(words), 1024):
            some = order[at : at + 1024]
            codes, weights = _subsequences([words[i] for i in some])
            features = self.feature[codes]
            rows, cols = np.nonzero(features)
            if len(rows) == 0:
                continue
            # the subsequences of a word that any landmark has, packed to the left, words with many of them first
            hits = np.bincount(rows, minlength=len(some))
            place = np.empty(len(some), np.int64)
            busy = np.argsort(-hits, kind="stable")
            place[busy] = np.arange(len(some))
            packed = np.zeros((hits.max(), len(some)), np.int64)
            rank = np.arange(len(rows)) - np.repeat(np.cumsum(hits) - hits, hits)
            packed[rank, place[rows]] = self.copy[cols] * len(self.table) + features[rows, cols]
            sums = np.zeros((int((hits > 0).sum()), len(self.landmarks)), np.float32)
            taken = np.empty_like(sums)
            for line, n in zip(packed, len(some) - np.searchsorted(np.sort(hits), np.arange(hits.max()), "right")):
                np.take(self.weighted, line[:n], axis=0, out=taken[:n], mode="clip")
                sums[:n] += taken[:n]
            own = busy[: len(sums)]
            out[some[own]] = sums / np.maximum(_norms(codes[own], weights), 1e-6)[:, None].astype(np.float32)
        return out


class Describer:
    """Best and mean likeness of a text's words to each landmark, with a bounded memo of words."""

    def __init__(self, landmarks: list[str]):
        self.kernel = Likeness(landmarks)
        self.memo: dict[str, int] = {}
        self.again = np.zeros(MEMO + BLOCK, bool)  # met again since it was learned
        self.known = np.zeros((MEMO + BLOCK, len(landmarks)), np.float32)

    def _rows(self, words: list[str]) -> np.ndarray:
        """Likeness of each word, at most ``BLOCK`` of them: that of its best piece."""
        if len(self.memo) > MEMO:
            self._forget()
        places = np.fromiter((self.memo.get(w, -1) for w in words), np.int64, len(words))
        unknown = np.flatnonzero(places < 0).tolist()
        self.again[places[places >= 0]] = True
        new = list(dict.fromkeys(words[i] for i in unknown))
        pieces = [_pieces(w) for w in new]
        base = len(self.memo)
        self.known[base : base + len(new)] = 0
        owner = np.repeat(np.arange(base, base + len(new)), [len(p) for p in pieces])
        flat = [p for ps in pieces for p in ps]
        for at in range(0, len(flat), BLOCK):
            own = owner[at : at + BLOCK]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            best = np.maximum.reduceat(self.kernel(flat[at : at + BLOCK]), first, axis=0)
            self.known[own[first]] = np.maximum(self.known[own[first]], best)
        self.memo.update(zip(new, range(base, base + len(new))))
        for i in unknown:
            places[i] = self.memo[words[i]]
        return np.take(self.known, places, axis=0, mode="clip")

    def _forget(self) -> None:
        """Keep the words that were met again, or none if these are too many."""
        kept = np.flatnonzero(self.again[: len(self.memo)])
        if len(kept) > MEMO // 2:
            kept = kept[:0]
        words = list(self.memo)
        self.memo = {words[i]: at for at, i in enumerate(kept)}
        self.known[: len(kept)] = self.known[kept]
        self.again[:] = False

    def __call__(self, texts: list[bytes | None]) -> np.ndarray:
        size = len(self.kernel.landmarks)
        best, total = np.zeros((len(texts), size), np.float32), np.zeros((len(texts), size), np.float64)
        counted = np.zeros(len(texts))
        words: list[str] = []
        times: list[int] = []
        owner: list[int] = []

        def settle():
            if not words:
                return
            rows, own = self._rows(words), np.array(owner)
            number = np.array(times, np.float32)
            powers = rows * rows
            for _ in range(POWER - 2):
                powers *= rows
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            for a, b in zip(first, [*first[1:], len(own)]):
                best[own[a]] = np.maximum(best[own[a]], rows[a:b].max(axis=0))
                total[own[a]] += number[a:b] @ powers[a:b]
            for held in (words, times, owner):
                held.clear()

        for i, t in enumerate(texts):
            found = words_of((t or b"").decode("utf-8", "replace"))
            counted[i] = found.total()
            kinds, numbers = list(found), list(found.values())
            while kinds:
                room = BLOCK - len(words)
                words += kinds[:room]
                times += numbers[:room]
                owner += [i] * len(kinds[:room])
                kinds, numbers = kinds[room:], numbers[room:]
                if len(words) >= BLOCK:
                    settle()
        settle()
        return np.hstack((best, np.log1p(PER * total / np.maximum(counted, 1)[:, None])))


def _sampled(docs: DataFrame, labels: DataFrame, text: str, key: str, label: str, sample: int) -> DataFrame:
    known = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).join(
        labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y is not null"), "k"
    )
    total = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).count()
    share = int(min(1.0, sample / max(1, total)) * (1 << 20))
    return known.where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < share)


def _strings(text: bytes | None) -> dict[str, float]:
    """Possible landmarks in a text, whole words and word beginnings: log(1 + PER * share of its words)."""
    words = words_of((text or b"").decode("utf-8", "replace"))
    times: Counter[str] = Counter()
    for w, n in words.items():
        for part in {w[:size] for size in STEMS if len(w) > size} | ({w} if 3 <= len(w) <= LONGEST else set()):
            times[part] += n
    total = max(1, words.total())
    return {w: float(np.log1p(PER * n / total)) for w, n in times.items()}


def _landmarks(picked: DataFrame, count: int) -> list[str]:
    """Words and word beginnings more common in toxic texts than in others, no two of them alike, found on the sample."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per string of a task's texts (the sample is bounded): bad, all and squared rates, and texts."""
        found: dict[str, list[float]] = {}
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w, rate in _strings(text).items():
                    row = found.get(w)
                    if row is None:
                        row = found[w] = [0.0, 0.0, 0.0, 0]
                    row[0] += y * rate
                    row[1] += rate
                    row[2] += rate * rate
                    row[3] += 1
        words, rows = list(found), list(found.values())
        for at in range(0, len(words), BLOCK):
            columns = [pa.array(c) for c in zip(*rows[at : at + BLOCK])]
            yield pa.RecordBatch.from_arrays([pa.array(words[at : at + BLOCK]), *columns], names=["w", "bad", "all", "squares", "n"])

    each = picked.select(F.col("t").cast("binary").alias("t"), "y").mapInArrow(sums, "w string, bad double, all double, squares double, n bigint")
    counts = each.groupBy("w").agg(*[F.sum(c).alias(c) for c in ("bad", "all", "squares", "n")]).where("n >= 5")
    share = picked.agg(F.avg("y")).first()[0] or 0.0
    lift = F.round((F.col("bad") - F.col("all") * share) / F.sqrt(F.col("squares") * max(share * (1 - share), 1e-9)), 6)
    best = [r["w"] for r in counts.withColumn("z", lift).where(F.col("z") >= EVIDENCE).orderBy(F.desc("z"), F.desc(F.length("w")), "w").limit(CANDIDATES).collect()]
    chosen: list[str] = []
    if best:
        codes, weights = _subsequences(best)
        lengths, near = np.maximum(_norms(codes, weights), 1e-6), np.zeros(len(best))
        for i, w in enumerate(best):
            if near[i] < 0.65 and len(chosen) < count:
                chosen.append(w)
                own = np.zeros(_ALPHABET**3, np.float32)
                np.add.at(own, codes[i], weights)
                own[0] = 0
                near = np.maximum(near, (own[codes] @ weights) / (lengths * lengths[i]))
    return chosen


def _svm(x: np.ndarray, y: np.ndarray, reg: float = 1e-2, steps: int = 400) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM with class weights, by accelerated gradient steps."""
    signs = np.where(y > 0, 1.0, -1.0)
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    design = np.hstack((x, np.ones((len(x), 1))))
    slope = 2 * np.linalg.eigvalsh(design.T @ (design * weight[:, None]))[-1] + reg
    w = past = np.zeros(design.shape[1])
    for step in range(steps):
        ahead = w + (step / (step + 3)) * (w - past)
        gap = np.maximum(0, 1 - signs * (design @ ahead))
        gradient = -2 * design.T @ (weight * gap * signs) + reg * np.append(ahead[:-1], 0)
        past, w = w, ahead - gradient / slope
    return w[:-1], w[-1]


def _curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve over the margin, by Newton steps with smoothed labels."""
    pos, neg = max(1, int((y > 0).sum())), max(1, int((y <= 0).sum()))
    goal = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        v = p * (1 - p) + 1e-9
        g = np.array([((p - goal) * margin).sum() + 1e-3 * a, (p - goal).sum()])
        h = np.array([[(v * margin * margin).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        a, b = a - float(np.clip(d[0], -5, 5)), b - float(np.clip(d[1], -5, 5))
    return a, b


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample: int = SAMPLE, landmarks: int = LANDMARKS) -> dict:
    """Model from about ``sample`` labelled texts at most, picked by a hash of the key."""
    prepare(docs.sparkSession)
    picked = _sampled(docs, labels, text, key, label, sample).persist()
    try:
        chosen = _landmarks(picked, landmarks)
        share = float(picked.agg(F.avg("y")).first()[0] or 0.0)
        if not chosen or share in (0.0, 1.0):
            return {"landmarks": [], "share": share}
        described = describe(picked, chosen, "t", ["y"]).toPandas()  # sample x 2 landmarks numbers at most
    finally:
        picked.unpersist()
    y = described["y"].to_numpy()
    return {**train(np.stack(described["likeness"].to_numpy()).astype(np.float64), y, chosen), "share": share}


def _parts(k: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """A description with the rise of the best likeness over the usual one."""
    return np.hstack((k, RISE * np.clip((k[:, : len(usual)] - usual) / ABOVE, 0, 1)))


def train(k: np.ndarray, y: np.ndarray, chosen: list[str]) -> dict:
    """SVM and curve from the descriptions of labelled texts."""
    usual = np.quantile(k[y <= 0, : len(chosen)], USUAL, axis=0)
    k = _parts(k, usual)
    values, vectors = np.linalg.eigh(Likeness(chosen)(chosen).astype(np.float64) + 1e-6 * np.eye(len(chosen)))
    nystrom = vectors / np.sqrt(np.maximum(values, 0.05))
    mapped = np.kron(np.eye(3), nystrom)  # all three parts are mapped alike
    w, bias = _svm(k @ mapped, y)
    direction = mapped @ w  # margin = description @ direction + bias
    a, b = _curve(k @ direction + bias, y)
    return {"landmarks": chosen, "direction": direction, "bias": bias, "curve": (a, b), "usual": usual}


def describe(docs: DataFrame, landmarks: list[str], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append likeness: two numbers per landmark."""
    shared = docs.sparkSession.sparkContext.broadcast(landmarks)

    def make():
        described = Describer(shared.value)
        return lambda texts: {"likeness": list(described(texts).astype(np.float64))}

    return per_text(docs, text, make, {"likeness": "array<double>"}, keep)


_DESCRIBERS: dict[int, Describer] = {}


def score(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append score (0 to 1) and predicted (score >= 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        key = hash(tuple(m["landmarks"]))
        if m["landmarks"] and key not in _DESCRIBERS:
            _DESCRIBERS.clear()
            _DESCRIBERS[key] = Describer(m["landmarks"])

        def work(texts):
            if m["landmarks"]:
                margin = _parts(_DESCRIBERS[key](texts), m["usual"]) @ m["direction"] + m["bias"]
                a, b = m["curve"]
                value = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
            else:
                value = np.full(len(texts), m["share"])
            return {"score": value, "predicted": (value >= 0.5).astype(np.int32)}

        return work

    return per_text(docs, text, make, {"score": "double", "predicted": "int"}, keep)
