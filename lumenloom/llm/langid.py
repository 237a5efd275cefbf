"""Language identification: multinomial naive Bayes over hashed character n-grams.

The model is one log-probability matrix of ``buckets`` rows and a column per
language, fitted on a bounded sample of labelled texts and broadcast; its size
depends on the parameters and the number of languages only. Scoring adds the
matrix rows of a text's n-grams in numpy, batch by batch, over whole texts.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as
is every text when nothing was learned; rows without a language teach nothing;
repeated rows count as often as they occur; extra columns are carried along or
ignored. The score is the posterior of the predicted language.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenloom.llm.common import per_text, prepare

BUCKETS = 1 << 15
ORDERS = (2, 3)
SAMPLE = 40_000  # expected bound of texts used for fitting
_PIECE = 1 << 20

_ASCII = np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint32)


def _codes(data: bytes) -> np.ndarray:
    """Lower-cased code points; ASCII other than letters becomes a blank."""
    codes = np.frombuffer(data.decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), np.uint32)
    return np.where(codes < 128, _ASCII[np.minimum(codes, 127)], codes)


def _grams(codes: np.ndarray, buckets: int, orders: tuple[int, ...]):
    for n in orders:
        if len(codes) < n:
            continue
        h = np.zeros(len(codes) - n + 1, np.uint32)
        for i in range(n):
            h = (h + codes[i : len(codes) - n + 1 + i]) * np.uint32(0x9E3779B1 + 2 * n)
            h ^= h >> np.uint32(15)
        yield h % np.uint32(buckets)


def _pieces(data: bytes, orders: tuple[int, ...]):
    """Code points with blanks around, in pieces that overlap by the longest n-gram."""
    codes = np.concatenate(([32], _codes(data), [32])).astype(np.uint32)
    step = max(orders) - 1
    for at in range(0, max(len(codes) - step, 1), _PIECE):
        yield codes[at : at + _PIECE + step]


def _gram_pieces(data: bytes, buckets: int, orders: tuple[int, ...]):
    """Each n-gram of the text once."""
    longest = max(orders)
    for piece in _pieces(data, orders):
        last = len(piece) < _PIECE + longest - 1
        for n, h in zip([n for n in orders if len(piece) >= n], _grams(piece, buckets, orders)):
            yield h if last else h[:_PIECE]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", buckets: int = BUCKETS, orders: tuple[int, ...] = ORDERS, sample: int = SAMPLE, smooth: float = 0.5):
    """(languages, matrix, priors) from about ``sample`` labelled texts at most, picked by a hash of the key."""
    prepare(docs.sparkSession)
    known = docs.select(F.col(text).alias("t"), F.col(lang).cast("string").alias("lang"), F.col(key).alias("k")).where("t is not null and lang is not null")
    total = docs.where(F.col(lang).isNotNull()).count()  # reads no text
    share = int(min(1.0, sample / max(1, total)) * (1 << 20))
    picked = known.where(F.pmod(F.xxhash64(F.coalesce(F.col("k").cast("string"), F.lit(""))), F.lit(1 << 20)) < share)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}
        for b in batches:
            for data, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                into = sums.setdefault(name, np.zeros(buckets, np.int64))
                docs_of[name] = docs_of.get(name, 0) + 1
                for h in _gram_pieces(data, buckets, orders):
                    into += np.bincount(h, minlength=buckets)
        for name, into in sums.items():
            at = np.flatnonzero(into)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (len(at) + 1)), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(into[at], docs_of[name]), pa.int64())], names=["lang", "bucket", "n"]
            )

    counts = picked.select(F.col("t").cast("binary"), "lang").mapInArrow(count, "lang string, bucket int, n bigint")
    rows = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most languages * (buckets + 1) rows
    langs = sorted(rows["lang"].unique())
    matrix = np.full((buckets, len(langs)), smooth)
    priors = np.ones(len(langs))
    for i, name in enumerate(langs):
        own = rows[rows["lang"] == name]
        at, n = own["bucket"].to_numpy(), own["n"].to_numpy()
        matrix[at[at >= 0], i] += n[at >= 0]
        priors[i] = n[at < 0].sum()
    if langs:
        matrix = np.log(matrix / matrix.sum(axis=0))
        priors = np.log(priors / priors.sum())
    return langs, matrix.astype(np.float32), priors


def predict(docs: DataFrame, model, text: str = "text", keep: list[str] | None = None, orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """Append lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    letter = "_letter"
    while letter in docs.columns:
        letter += "_"
    marked = docs.withColumn(letter, has_letter(F.col(f"`{text}`")))

    def make():
        langs, matrix, priors = shared.value
        buckets = len(matrix)

        def work(texts):
            best, score = [], []
            for data in texts:
                if not langs or not data:
                    best.append("und")
                    score.append(0.0)
                    continue
                total = priors.copy()
                for h in _gram_pieces(data, buckets, orders):
                    seen = np.bincount(h, minlength=buckets) if len(h) > buckets else None
                    total += seen @ matrix if seen is not None else matrix[h].sum(axis=0, dtype=np.float64)
                i = int(np.argmax(total))
                best.append(langs[i])
                score.append(float(1.0 / np.exp(total - total[i]).sum()))
            return {"lang_pred": best, "score": score}

        return work

    out = per_text(marked, text, make, {"lang_pred": "string", "score": "double"}, [*names, letter])
    return out.select(
        *[F.col(f"`{c}`") for c in names],
        F.when(F.col(letter), F.col("lang_pred")).otherwise("und").alias("lang_pred"),
        F.when(F.col(letter), F.col("score")).otherwise(0.0).alias("score"),
    )


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike("\\p{L}"), F.lit(False))
