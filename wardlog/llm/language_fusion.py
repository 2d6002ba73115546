"""Language identification by Bayesian fusion of text, declared language, address suffix and host.

Text likelihoods come from byte trigrams hashed to `BUCKETS` counts per language, trained on all rows that declare one of
the languages; a uniform model stands for text in none of them. The mean log-likelihood per trigram counts for at most
`WEIGHT` trigrams, since neighbouring trigrams are not independent. The declaration enters by how often each value is
declared for texts of each language. The prior of a host is smoothed towards that of its address suffix, and this
towards that of the corpus, each by `PRIOR` pseudo-rows; all are grouped aggregates over every row. Counts of hosts
stay a table that is joined; the text models and the declaration table have a fixed size.

The posterior's best language is returned. A row is rejected where the best is none of the languages (`und`) or its
posterior is below `LEAST`.

Edge cases: null, empty and letterless texts are `und` and rejected. A null or foreign declaration is a value of its own;
region subtags are ignored. A host that is null, or has no dot, has no suffix. Repeated rows get a row each. If no row
declares a language nothing is known and nothing is rejected. An empty table gives an empty result. Whole texts are
read. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlog.llm.common import Batches, as_batch, ascii_lower, text_of, tidy
from wardlog.session import stage

LANGUAGES = ("de", "en", "es", "fr")
UNKNOWN = "und"
BUCKETS = 1 << 14
SMOOTHING, WEIGHT, PRIOR, LEAST = 0.5, 60, 10.0, 0.5
#: Share of rows in none of the languages, before any evidence.
UNKNOWN_SHARE = 0.01

_CLASSES = (*LANGUAGES, UNKNOWN)
_COUNTS = pa.schema([("language", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])
_DDL = "doc_id long, declared string, host string, n_grams long, " + ", ".join(f"t_{c} double" for c in _CLASSES)
_SCORES = pa.schema(
    [("doc_id", pa.int64()), ("declared", pa.string()), ("host", pa.string()), ("n_grams", pa.int64()), *[(f"t_{c}", pa.float64()) for c in _CLASSES]]
)
#: Bytes other than ASCII letters and parts of UTF-8 characters count as blanks.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the lower-cased text that hold a letter; runs of other characters are one blank."""
    plain = b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())
    if not plain:
        return np.zeros(0, np.int64)
    b = np.frombuffer(b" " + plain + b" ", np.uint8).astype(np.uint32)
    mixed = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2_654_435_761)
    return (mixed >> np.uint32(18)).astype(np.int64)


@tidy()
def _tally(batches: Batches) -> Batches:
    """Trigram counts of the task's rows by declared language."""
    counts = {c: np.zeros(BUCKETS, np.int64) for c in LANGUAGES}
    for batch in batches:
        for declared, text in zip(batch.column("declared").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if declared in counts:
                grams = trigrams(text)
                if len(grams) > BUCKETS // 8:
                    counts[declared] += np.bincount(grams, minlength=BUCKETS)
                else:
                    np.add.at(counts[declared], grams, 1)
    for language, own in counts.items():
        filled = np.flatnonzero(own)
        yield as_batch(_COUNTS, language=[language] * len(filled), bucket=filled.astype(np.int32), n=own[filled])


def text_model(rows: DataFrame) -> np.ndarray | None:
    """Log probability of each bucket in each class; None if no row declares a language."""
    tallies = rows.select("declared", "text").mapInArrow(_tally, "language string, bucket int, n long")
    found = tallies.groupBy("language", "bucket").agg(F.sum("n").alias("n")).toPandas()
    if not len(found):
        return None
    counts = np.zeros((BUCKETS, len(_CLASSES)))
    for place, language in enumerate(LANGUAGES):
        own = found[found["language"] == language]
        counts[own["bucket"], place] = own["n"]
    totals = counts.sum(axis=0)
    logs = np.log((counts + SMOOTHING) / (totals + SMOOTHING * BUCKETS))
    logs[:, -1] = -math.log(BUCKETS)
    logs[:, :-1][:, totals[:-1] == 0] = -2 * math.log(BUCKETS)  # never declared: never chosen by its text
    return logs


def _means(texts: pa.Array, model: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Number of trigrams and mean log-likelihood per class of each text; trigrams of one text at a time are held."""
    sizes, means = [], np.zeros((len(texts), len(_CLASSES)))
    for at, text in enumerate(texts):
        grams = trigrams(text.as_py())
        sizes.append(len(grams))
        if len(grams):
            means[at] = model[grams].mean(axis=0)
    return sizes, means


def text_scores(rows: DataFrame, model: np.ndarray) -> DataFrame:
    """doc_id, declared, host, n_grams and the mean log-likelihood per class."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    @tidy()
    def score(batches: Batches) -> Batches:
        for batch in batches:
            sizes, means = _means(batch.column("text"), held.value)
            columns = {n: batch.column(n) for n in ("doc_id", "declared", "host")} | {f"t_{c}": means[:, i] for i, c in enumerate(_CLASSES)}
            yield as_batch(_SCORES, n_grams=sizes, **columns)

    return rows.select("doc_id", "declared", "host", "text").mapInArrow(score, _DDL)


def primary_subtag(declared: Column) -> Column:
    """A declared language without region, one of LANGUAGES, `other` or `none`."""
    tag = F.regexp_extract(ascii_lower(F.trim(declared)), r"^[a-z]+", 0)
    return F.when(declared.isNull() | (F.trim(declared) == ""), "none").when(tag.isin(*LANGUAGES), tag).otherwise("other")


def _best(values: dict[str, Column]) -> Column:
    """The class with the largest value; the first of equal ones in order of _CLASSES."""
    ranked = [F.struct(v.alias("v"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, (c, v) in enumerate(values.items())]
    return F.greatest(*ranked)["c"]


def identify(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    declared: Column | None = None,
    host: Column | None = None,
) -> DataFrame:
    """One row per input row: doc_id, declared, host, n_grams, language, posterior, kept."""
    declared = F.col("lang") if declared is None else declared
    host = F.col("source") if host is None else host
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        primary_subtag(declared.cast("string")).alias("declared"),
        host.cast("string").alias("host"),
        text_of(text).alias("text"),
    )
    model = text_model(rows)
    if model is None:
        language = F.when(F.col("declared").isin(*LANGUAGES), F.col("declared")).otherwise(UNKNOWN)
        return rows.select("doc_id", "declared", "host", F.lit(0).cast("long").alias("n_grams"), language.alias("language"), F.lit(0.0).alias("posterior"), F.lit(True).alias("kept"))
    scored = text_scores(rows, model)
    by_text = F.when(F.col("n_grams") > 0, _best({c: F.col(f"t_{c}") for c in _CLASSES}))
    suffix = F.regexp_extract(ascii_lower(F.col("host")), r"\.([^.]+)$", 1)
    scored = stage(scored.withColumn("by_text", by_text).withColumn("suffix", suffix), "language_text")

    counted = scored.where("by_text IS NOT NULL").groupBy("host", "suffix").agg(
        F.count("*").alias("n"), *[F.sum((F.col("by_text") == c).cast("long")).alias(f"n_{c}") for c in _CLASSES]
    )
    hosts = stage(counted, "hosts")
    sums = [F.sum("n").alias("n"), *[F.sum(f"n_{c}").alias(f"n_{c}") for c in _CLASSES]]
    all_rows = hosts.agg(*sums).first()
    total = all_rows["n"] or 0
    start = {c: UNKNOWN_SHARE if c == UNKNOWN else (1 - UNKNOWN_SHARE) / len(LANGUAGES) for c in _CLASSES}
    of_all = {c: ((all_rows[f"n_{c}"] or 0) + PRIOR * start[c]) / (total + PRIOR) for c in _CLASSES}
    suffixes = hosts.where("suffix <> ''").groupBy("suffix").agg(*sums).select(
        "suffix", *[((F.col(f"n_{c}") + PRIOR * of_all[c]) / (F.col("n") + PRIOR)).alias(f"s_{c}") for c in _CLASSES]
    )
    priors = stage(
        hosts.join(suffixes, "suffix", "left").select(
            "host",
            *[((F.col(f"n_{c}") + PRIOR * F.coalesce(f"s_{c}", F.lit(of_all[c]))) / (F.col("n") + PRIOR)).alias(f"p_{c}") for c in _CLASSES],
        ),
        "priors",
    )
    pairs = {(r.declared, r.by_text): r.n for r in scored.where("by_text IS NOT NULL").groupBy("declared", "by_text").agg(F.count("*").alias("n")).collect()}
    values = sorted({d for d, _ in pairs}) or ["none"]

    def declared_given(c: str) -> Column:
        """log P(declared value | language c); without rows of c, how often the value is declared at all."""
        of_class = sum(pairs.get((d, c), 0) for d in values)
        logs = F.lit(0.0)
        for d in values:
            usual = sum(n for (x, _), n in pairs.items() if x == d) / max(1, total)
            logs = F.when(F.col("declared") == d, math.log((pairs.get((d, c), 0) + PRIOR * max(usual, 1e-6)) / (of_class + PRIOR))).otherwise(logs)
        return logs

    weight = F.least(F.col("n_grams"), F.lit(WEIGHT))
    joint = {
        c: weight * F.col(f"t_{c}") + declared_given(c) + F.log(F.coalesce(f"p_{c}", F.lit(of_all[c])))
        for c in _CLASSES
    }
    fused = scored.join(priors.withColumnRenamed("host", "of_host"), F.col("host").eqNullSafe(F.col("of_host")), "left").select(
        "doc_id", "declared", "host", "n_grams", *[v.alias(f"j_{c}") for c, v in joint.items()]
    )
    top = F.greatest(*[F.col(f"j_{c}") for c in _CLASSES])
    parts = [F.exp(F.col(f"j_{c}") - top) for c in _CLASSES]
    language = F.when(F.col("n_grams") > 0, _best({c: F.col(f"j_{c}") for c in _CLASSES})).otherwise(UNKNOWN)
    posterior = F.when(F.col("n_grams") > 0, 1 / sum(parts[1:], parts[0])).otherwise(0.0)
    return fused.select("doc_id", "declared", "host", "n_grams", language.alias("language"), posterior.alias("posterior")).withColumn(
        "kept", (F.col("language") != UNKNOWN) & (F.col("posterior") >= LEAST)
    )
