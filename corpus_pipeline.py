"""Corpus pipeline: each stage applies one operator to what the stage before it kept.

A stage function takes (spark, docs, sf_dir) and returns documents with the columns of its input; only the last one
returns packed pieces instead. Decisions are written to the shared folder first, so that their size is known when they
are joined to the texts. A decision names a row by id and text, so rows that share an id but hold different texts are
decided one by one, and so are rows without an id. Rows that repeat id and text become one row in exact deduplication.
Each stage begins with executors' heaps that hold no free memory of the stage before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlog.llm import cuckoo_index, histogram_packing, language_fusion, source_schedule, tensored_minhash
from wardlog.llm.common import SPACE, prepare, shrink_heaps, table, text_of
from wardlog.session import remove, scratch, scratch_path, stage

#: The stages are iterative and tested against a brute-force run; SQL can't express them.
ORACLE_SQL = None


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that the documents do not have."""
    while name in docs.columns:
        name += "_"
    return name


def _row_key() -> Column:
    """A 64-bit hash of all that the operators read of a row; rows that agree in it have equal decisions."""
    read = [F.col(c) for c in ("doc_id", "text", "lang", "source")]
    return F.xxhash64(*[part for c in read for part in (c, c.isNull())])


def _named(docs: DataFrame) -> DataFrame:
    """What the operators read, with the row key as id."""
    return docs.select(_row_key().alias("doc_id"), "text", "lang", "source")


#: Decisions of so many rows at most (about 40 MB in a task's hash table) are broadcast, so that texts stay where they are.
BROADCAST_ROWS = 1 << 19


def _small(decisions: DataFrame) -> DataFrame:
    """Staged decisions, broadcast if their counted size allows; otherwise texts and decisions are shuffled."""
    return F.broadcast(decisions) if decisions.count() <= BROADCAST_ROWS else decisions


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Documents whose row key is not among the staged keys."""
    own = gone.columns[0]
    return docs.withColumn(own, _row_key()).join(_small(gone), own, "left_anti").select(docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are in none of the languages, or whose language stays open."""
    shrink_heaps(spark)
    with scratch(spark):
        found = language_fusion.identify(_named(docs)).where("NOT kept")
        gone = stage(found.select(F.col("doc_id").alias(_fresh(docs, "row_key"))).distinct(), "gone", keep=True)
    return _without(docs, gone)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of equal texts, once."""
    shrink_heaps(spark)
    own = _fresh(docs, "digest")
    with scratch(spark):
        found = stage(cuckoo_index.dedup(docs), "copies")
        dropped = found.where("NOT kept").select(F.col("doc_id").alias("of_id"), F.unhex("text_sha256").alias("of_digest"))
        gone = stage(dropped.distinct(), "gone", keep=True)
        repeated = not found.where("kept").groupBy("doc_id", "text_sha256").count().where("count > 1").isEmpty()
    digest = F.unhex(F.sha2(F.regexp_replace(text_of("text"), SPACE, " "), 256))
    keyed = docs.withColumn(own, digest)
    left = keyed.join(_small(gone), keyed["doc_id"].eqNullSafe(gone["of_id"]) & (keyed[own] == gone["of_digest"]), "left_anti")
    return (left.dropDuplicates(["doc_id", own]) if repeated else left).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of near duplicates (five words, 0.8)."""
    shrink_heaps(spark)
    with scratch(spark):
        found = tensored_minhash.near_duplicates(_named(docs)).select("doc_id", "component_id")
        ids = docs.select(_row_key().alias("row_key"), F.col("doc_id").cast("long").alias("id"))
        members = stage(found.distinct().join(ids.distinct(), found["doc_id"] == ids["row_key"]).select("component_id", "id", "row_key"), "members")
        # Rows without an id come last; the row key decides between texts of one id.
        first = members.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_key"))["row_key"].alias("first"))
        others = members.join(first, "component_id").where("row_key <> first").select(F.col("row_key").alias(_fresh(docs, "row_key")))
        gone = stage(others.distinct(), "gone", keep=True)
    return _without(docs, gone)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops whole documents as the mix takes them: a pass counts if it takes at least half of the words."""
    shrink_heaps(spark)
    own, key = _fresh(docs, "copies"), _fresh(docs, "row_key")
    with scratch(spark):
        mixed = source_schedule.mix(_named(docs))
        passes = [(2 * F.col("first_pass") >= F.col("size")).cast("int"), (2 * (F.col("taken") - F.col("first_pass")) >= F.col("size")).cast("int")]
        copies = F.when(F.col("size") > 0, passes[0] + passes[1]).otherwise(1)
        plan = stage(mixed.groupBy(F.col("doc_id").alias(key)).agg(F.max(copies).alias(own)).where(F.col(own) != 1), "mix", keep=True)
    joined = docs.withColumn(key, _row_key()).join(_small(plan), key, "left").withColumn(own, F.coalesce(own, F.lit(1)))
    repeated = joined.where(F.col(own) > 0).withColumn(own, F.explode(F.sequence(F.lit(1), own)))
    return repeated.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 2048 tokens."""
    shrink_heaps(spark)
    return histogram_packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`; each stage's documents are written once, read by the next and then removed."""
    prepare(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, work in STAGES[:-1]:
        path = scratch_path(spark, name)
        with scratch(spark):  # decisions go when the stage is written, its documents when the next one is
            work(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
