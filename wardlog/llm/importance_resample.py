"""Quality selection by importance resampling.

Two bag-of-n-grams models on hashed words and word pairs, one of the target texts and one of all raw texts, give each
document the log ratio of its likelihoods. The raw model counts every document of the corpus. The target model is fitted
on at most `target_rows` labelled rows, the only bound in this operator; their ids are few enough to be broadcast. The
models are two arrays of `BUCKETS` counts, whatever the corpus.

The log ratio is taken relative to an average target text of the same number of n-grams, so that length alone neither
saves nor loses a text. Adding Gumbel noise and keeping the k largest sums draws k documents without replacement in
proportion to their weights. The noise is a hash of id, text and a number among equal rows, so each row draws its own and
the draw depends on neither the files' layout nor a rerun; the cut is found by counting digits, without sorting, and
equal sums at the cut are settled by a second 60-bit hash of the same. Unless given, k is the share of target labels among
all labels, times the number of documents.

Edge cases: null and empty texts have no n-grams and weight 0. Repeated rows take part one by one; so do rows with null
ids. Without target labels all weights are 0. Labels of unknown ids change nothing. An empty table gives an empty
result. Whole texts are read. Extra columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlog.llm.common import Batches, as_batch, text_of, words_of
from wardlog.llm.cutoff import kth_largest
from wardlog.llm.histogram_packing import numbered
from wardlog.session import stage

BUCKETS = 1 << 18
TARGET_ROWS = 20_000
#: Counts that both models get in each bucket, so that rare n-grams, which the target sample can't show, weigh little.
SMOOTHING = 16.0
#: Sums are compared in units of 2^-UNIT_BITS.
UNIT_BITS, KEY_BITS = 20, 60
CACHED_WORDS = 500_000

_COUNTS = pa.schema([("bucket", pa.int32()), ("raw", pa.int64()), ("target", pa.int64())])
_WEIGHTS = pa.schema([("doc_id", pa.int64()), ("n_grams", pa.int64()), ("log_weight", pa.float64()), ("same", pa.binary())])


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


@lru_cache(maxsize=1)
def _word_hashes() -> WordHashes:
    return WordHashes()


def gram_buckets(text: str) -> np.ndarray:
    """Buckets of the words and of the pairs of neighbouring words."""
    words = words_of(text)
    hashes = np.fromiter(map(_word_hashes().__getitem__, words), np.uint64, len(words))
    pairs = hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]
    pairs ^= pairs >> np.uint64(29)
    grams = np.concatenate([hashes, pairs * np.uint64(0xBF58476D1CE4E5B9)])
    return (grams >> np.uint64(40)).astype(np.int64) % BUCKETS


def _tally(batches: Batches) -> Batches:
    """Counts of each bucket over the rows of the task."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text, chosen in zip(batch.column("text").to_pylist(), batch.column("chosen").to_pylist(), strict=True):
            counts = np.bincount(grams, minlength=BUCKETS) if len(grams := gram_buckets(text)) > BUCKETS // 8 else None
            for into in (raw, target) if chosen else (raw,):
                if counts is None:
                    np.add.at(into, grams, 1)
                else:
                    into += counts
    filled = np.flatnonzero(raw)
    yield as_batch(_COUNTS, bucket=filled.astype(np.int32), raw=raw[filled], target=target[filled])


def target_ids(labels: DataFrame, rows: int = TARGET_ROWS) -> DataFrame:
    """At most `rows` ids of good, non-toxic labelled rows, drawn by a hash of the id."""
    good = labels.where("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"))
    return good.distinct().orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(rows)


def fit(docs: DataFrame, labels: DataFrame, target_rows: int = TARGET_ROWS) -> np.ndarray:
    """Log ratio of target to raw for each bucket, relative to its mean over the target's n-grams."""
    chosen = F.broadcast(target_ids(labels, target_rows).withColumn("chosen", F.lit(True)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text")).join(chosen, "doc_id", "left")
    tallies = rows.select("text", F.coalesce("chosen", F.lit(False)).alias("chosen")).mapInArrow(_tally, "bucket int, raw long, target long")
    found = tallies.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[found["bucket"]], target[found["bucket"]] = found["raw"], found["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    expected = raw * (target.sum() / raw.sum())
    ratio = np.log(target + SMOOTHING) - np.log(expected + SMOOTHING)
    return ratio - (target * ratio).sum() / target.sum()


def row_digest(doc_id: int | None, text: str) -> bytes:
    """128 bits that rows of equal id and text share."""
    return xxhash.xxh3_128_digest(f"{doc_id} {text}".encode("utf-8", "surrogatepass"))


def weights(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(doc_id, n_grams, log_weight, same) of every row; `same` names the rows of one id and text."""
    held = docs.sparkSession.sparkContext.broadcast(ratio)

    def score(batches: Batches) -> Batches:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            grams = [gram_buckets(t) for t in texts]
            sums = [float(held.value[g].sum()) for g in grams]
            same = [row_digest(i, t) for i, t in zip(ids, texts, strict=True)]
            yield as_batch(_WEIGHTS, doc_id=ids, n_grams=[len(g) for g in grams], log_weight=sums, same=same)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"))
    return rows.mapInArrow(score, "doc_id long, n_grams long, log_weight double, same binary")


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, target_rows: int = TARGET_ROWS, seed: int = 3) -> DataFrame:
    """One row per document: doc_id, n_grams, log_weight, kept (drawn by Gumbel top-k)."""
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "same", "rank"), 11) + 0.5) / F.lit(float(1 << 53))
    total = F.col("log_weight") - F.log(-F.log(uniform))
    middle = F.lit(1 << (KEY_BITS - 1))
    key = F.greatest(F.lit(0), F.least(F.lit((1 << KEY_BITS) - 1), F.floor(total * F.lit(float(1 << UNIT_BITS))) + middle))
    weighed = stage(weights(docs, fit(docs, labels, target_rows)).withColumn("row", F.monotonically_increasing_id()), "weighed")
    n = weighed.count()
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "same", "rank"), 64 - KEY_BITS)
    drawn = stage(numbered(weighed, "same", "row", n).select("doc_id", "n_grams", "log_weight", key.cast("long").alias("key"), place.alias("place")), "drawn")
    if k is None:
        seen = labels.agg(F.avg(F.when(F.expr("quality = 1 AND coalesce(toxic, 0) = 0"), 1.0).otherwise(0.0)).alias("share")).first()
        k = round(n * (1.0 if seen.share is None else seen.share))
    if k <= 0 or k >= n:
        return drawn.select("doc_id", "n_grams", "log_weight", F.lit(k > 0).alias("kept"))
    cut, larger = kth_largest(drawn, "key", k, KEY_BITS)
    last, _ = kth_largest(drawn.where(F.col("key") == cut), "place", k - larger, KEY_BITS)
    kept = (F.col("key") > cut) | ((F.col("key") == cut) & (F.col("place") >= last))
    return drawn.select("doc_id", "n_grams", "log_weight", kept.alias("kept"))
