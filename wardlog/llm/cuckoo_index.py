"""Exact deduplication on a cuckoo-filter index of live digests.

The index is a table cut into shards by digest. A shard holds one filter row (the packed fingerprint slots)
and its content: one row per live digest, ordered by the filter's primary bucket, with the smallest id and the
number of rows seen. A batch of keys is combined inside each input partition, so a text that makes up a third of
the rows becomes one row per Arrow batch, and then meets its shard in one task. There every key asks the filter:
a miss is new by construction and is stored; a hit is compared with the full digests in its bucket, which tells a
copy from a chance agreement of fingerprints. A filter that overflows is rebuilt with twice the buckets from the
stored keys of its shard. Deletion verifies the digest in the content before it takes the fingerprint out.

Edge cases: null text equals the empty text and white space only counts as one blank. Repeated rows with one id
are copies of each other. A null id never wins over another id. An empty table gives an empty result. Extra
columns are not read, whatever their names.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlog.llm.common import SPACE, Batches, bucket_count, text_of, tidy
from wardlog.session import stage

SLOTS = 4
MAX_KICKS = 200
#: Rows of one shard that the number of shards aims at; a shard is one task's working set.
SHARD_ROWS = 65_536
START_BUCKETS = 64

INDEX_SCHEMA = "shard int, bucket long, digest binary, keep_id long, n long, buckets long, slots binary"
_ARROW = pa.schema(
    [("shard", pa.int32()), ("bucket", pa.int64()), ("digest", pa.binary()), ("keep_id", pa.int64()),
     ("n", pa.int64()), ("buckets", pa.int64()), ("slots", pa.binary())]
)
_KEYS = pa.schema([("digest", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64())])


class CuckooFilter:
    """16-bit fingerprints in buckets of four slots; each key has two possible buckets."""

    def __init__(self, buckets: int = START_BUCKETS, slots: bytes | None = None):
        self.buckets = buckets
        self.slots = array("H", slots if slots is not None else bytes(2 * SLOTS * buckets))

    def places(self, digest: bytes) -> tuple[int, int, int]:
        """Fingerprint (never 0) and the two buckets."""
        mark = int.from_bytes(digest[:2], "little") % 65_535 + 1
        first = int.from_bytes(digest[2:10], "little") & (self.buckets - 1)
        return mark, first, self.other(first, mark)

    def other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & (self.buckets - 1))

    def __contains__(self, digest: bytes) -> bool:
        mark, first, second = self.places(digest)
        slots = self.slots
        return mark in slots[first * SLOTS : first * SLOTS + SLOTS] or mark in slots[second * SLOTS : second * SLOTS + SLOTS]

    def add(self, digest: bytes) -> bool:
        """False when no slot came free within the kicks; the filter must then be rebuilt larger."""
        mark, first, second = self.places(digest)
        for bucket in (first, second):
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.slots[at]:
                    self.slots[at] = mark
                    return True
        bucket = second
        for kick in range(MAX_KICKS):
            at = bucket * SLOTS + (kick + mark) % SLOTS
            mark, self.slots[at] = self.slots[at], mark
            bucket = self.other(bucket, mark)
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.slots[at]:
                    self.slots[at] = mark
                    return True
        return False

    def remove(self, digest: bytes) -> None:
        """Only for digests that are stored: another key's fingerprint could go otherwise."""
        mark, first, second = self.places(digest)
        for bucket in (first, second):
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.slots[at] == mark:
                    self.slots[at] = 0
                    return


class Shard:
    """One shard while it is changed: the filter and the content by primary bucket."""

    def __init__(self):
        self.filter = CuckooFilter()
        self.content: dict[int, dict[bytes, list]] = {}

    @classmethod
    def load(cls, rows: pa.Table) -> Shard:
        shard = cls()
        for row in rows.to_pylist():
            if row["digest"] is None:
                shard.filter = CuckooFilter(row["buckets"], row["slots"])
            else:
                shard.content.setdefault(row["bucket"], {})[row["digest"]] = [row["keep_id"], row["n"]]
        return shard

    def find(self, digest: bytes) -> list | None:
        """A filter hit is verified against the full digests in its bucket."""
        if digest not in self.filter:
            return None
        return self.content.get(self.filter.places(digest)[1], {}).get(digest)

    def insert(self, digest: bytes, doc_id: int | None, n: int) -> None:
        entry = self.find(digest)
        if entry is not None:
            entry[0] = doc_id if entry[0] is None else entry[0] if doc_id is None else min(entry[0], doc_id)
            entry[1] += n
            return
        self.content.setdefault(self.filter.places(digest)[1], {})[digest] = [doc_id, n]
        if not self.filter.add(digest):
            self.resize()

    def resize(self) -> None:
        """Rebuilds the filter from the stored keys, doubling until all of them fit."""
        entries = {d: e for bucket in self.content.values() for d, e in bucket.items()}
        fits = False
        while not fits:
            self.filter = CuckooFilter(self.filter.buckets * 2)
            fits = all(self.filter.add(d) for d in entries)
        self.content = {}
        for d, e in entries.items():
            self.content.setdefault(self.filter.places(d)[1], {})[d] = e

    def delete(self, digest: bytes) -> bool:
        if self.find(digest) is None:
            return False
        bucket = self.filter.places(digest)[1]
        del self.content[bucket][digest]
        self.filter.remove(digest)
        return True

    def rows(self, shard: int) -> pa.Table:
        found = [(b, d, e) for b in sorted(self.content) for d, e in sorted(self.content[b].items())]
        size = len(found)
        return pa.table(
            [
                pa.array([shard] * (size + 1), pa.int32()),
                pa.array([b for b, _, _ in found] + [None], pa.int64()),
                pa.array([d for _, d, _ in found] + [None], pa.binary()),
                pa.array([e[0] for _, _, e in found] + [None], pa.int64()),
                pa.array([e[1] for _, _, e in found] + [None], pa.int64()),
                pa.array([None] * size + [self.filter.buckets], pa.int64()),
                pa.array([None] * size + [self.filter.slots.tobytes()], pa.binary()),
            ],
            schema=_ARROW,
        )


@tidy()
def _combine(batches: Batches) -> Batches:
    """One row per digest of an Arrow batch: smallest id and number of rows."""
    for batch in batches:
        found = pa.Table.from_batches([batch]).group_by("digest").aggregate(
            [("doc_id", "min"), ("doc_id", "count", pc.CountOptions(mode="all"))]
        )
        yield from found.select(["digest", "doc_id_min", "doc_id_count"]).rename_columns(_KEYS.names).cast(_KEYS).to_batches()


def _insert(key: tuple, live: pa.Table, batch: pa.Table) -> pa.Table:
    shard = Shard.load(live)
    for digest, doc_id, n in zip(*(batch[c].to_pylist() for c in ("digest", "doc_id", "n")), strict=True):
        shard.insert(digest, doc_id, n)
    return shard.rows(key[0].as_py())


def _delete(key: tuple, live: pa.Table, batch: pa.Table) -> pa.Table:
    shard = Shard.load(live)
    for digest in batch["digest"].to_pylist():
        shard.delete(digest)
    return shard.rows(key[0].as_py())


def _lookup(key: tuple, live: pa.Table, batch: pa.Table) -> pa.Table:
    shard = Shard.load(live)
    entries = [(d, shard.find(d)) for d in dict.fromkeys(batch["digest"].to_pylist())]
    hits = [(d, e) for d, e in entries if e is not None]
    return pa.table(
        [pa.array([d for d, _ in hits], pa.binary()), pa.array([e[0] for _, e in hits], pa.int64()), pa.array([e[1] for _, e in hits], pa.int64())],
        names=["digest", "keep_id", "n"],
    )


@dataclass(frozen=True)
class CuckooIndex:
    """Live digests by shard; each change is a new table in the shared folder, so a failed change leaves the old one."""

    shards: int
    rows: DataFrame | None = None

    def _meet(self, keys: DataFrame, work, schema: str) -> DataFrame:
        spark = keys.sparkSession
        live = self.rows if self.rows is not None else spark.createDataFrame([], INDEX_SCHEMA)
        batch = keys.select(F.col("digest"), F.col("doc_id").cast("long")).mapInArrow(
            _combine, "digest binary, doc_id long, n long"
        )
        batch = batch.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(self.shards)).cast("int"))
        return live.groupBy("shard").cogroup(batch.groupBy("shard")).applyInArrow(work, schema)

    def insert(self, keys: DataFrame) -> CuckooIndex:
        """Adds (digest, doc_id) rows; rows of a live digest raise its count and may lower its smallest id."""
        return CuckooIndex(self.shards, stage(self._meet(keys, _insert, INDEX_SCHEMA), "cuckoo"))

    def delete(self, keys: DataFrame) -> CuckooIndex:
        """Takes out the digests of (digest, doc_id) rows; digests that are not live change nothing."""
        return CuckooIndex(self.shards, stage(self._meet(keys, _delete, INDEX_SCHEMA), "cuckoo"))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """(digest, keep_id, n) of the asked digests that are live."""
        return self._meet(keys, _lookup, "digest binary, keep_id long, n long")

    def content(self) -> DataFrame:
        return self.rows.where("digest IS NOT NULL").select("digest", "keep_id", "n")


def digest_keys(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest) of whole texts in which each run of white space counts as one blank."""
    plain = F.regexp_replace(text_of(text), SPACE, " ")
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.unhex(F.sha2(plain, 256)).alias("digest"))


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    keys = stage(digest_keys(docs, key, text), "digests")
    index = CuckooIndex(bucket_count(keys.count(), SHARD_ROWS, 256)).insert(keys)
    groups = index.content().where("n > 1")
    keep = F.coalesce("keep_id", "doc_id")
    return keys.join(groups, "digest", "left").select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
