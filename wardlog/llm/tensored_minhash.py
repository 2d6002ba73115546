"""Near-duplicate groups by MinHash with tensored banding, verified on full shingle sets.

Two collections of `SIDE` half keys are computed per text, each half key from `HALF` minhashes. Table keys are the pairs
of one half key of either collection: 2 * SIDE * HALF minhashes serve SIDE * SIDE tables of 2 * HALF minhashes each. A
pair of texts with similarity s shares a table with probability (1 - (1 - s^HALF)^SIDE)^2: 0.99998 at 0.85 and 0.9996 at
0.8. Half keys that one text has alone can't meet anyone and are dropped before pairs are formed, so a text without
relatives costs 2 * SIDE rows, not SIDE * SIDE.

Texts with equal shingle sets are one class from the start. Links are verified on the full sets in rounds: in each, a class is
linked to one class alone, the smallest of all that lead one of its buckets and are not yet in its component, so a round has
fewer links than classes, however many buckets two classes share. The first round's links are a forest, whose roots are
found by jumping; later links are contracted to the components they join. Buckets within one component need no further links; this joins
a large group of copies without its pairs. A bucket that still holds several components after `ROUNDS` is settled exactly: a class whose shingles are to more than a part of 1 - threshold its own can have no
partner and goes; what stays is collected to clusters, cut into blocks, and each pair of blocks counts intersections as
a matrix product and returns only links that join components. No bucket is capped and no link between different texts
is lost by this; the only loss is the probability above.

Edge cases: null text and texts without words have an empty set and are linked with nothing. Texts of fewer than `WIDTH`
words are one shingle. Repeated rows and equal texts are copies of the smallest id. Null ids never lend their id to a
group. An empty table gives an empty result. Whole texts are read, and extra columns are not.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlog.llm.common import Batches, ascii_lower, text_of, tidy, words_of
from wardlog.llm.components import components, merged, roots
from wardlog.session import scratch, stage

WIDTH, THRESHOLD = 5, 80
HALF, SIDE = 3, 12
#: Members of a block in the exact comparison; two blocks meet in one task.
BLOCK = 256
#: Rounds of links before what is left is compared exactly.
ROUNDS = 2
#: Word hashes kept by a task, shingles hashed at a time, and shingles compared at a time.
CACHED_WORDS, STRIPE, COLUMNS = 100_000, 1 << 15, 4_096

_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.binary()), ("keys", pa.list_(pa.int64()))])
_SIGNED_DDL = "doc_id long, n_shingles long, cls binary, keys array<long>"
_SETS = pa.schema([("cls", pa.binary()), ("n", pa.int64()), ("shingles", pa.list_(pa.int64()))])
_SETS_DDL = "cls binary, n long, shingles array<long>"


class WordHashes(dict):
    """64-bit hash of each word."""

    def __missing__(self, word: str) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found


@lru_cache(maxsize=1)
def _word_hashes() -> WordHashes:
    return WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a lower-cased text."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    known = _word_hashes()
    if len(known) > CACHED_WORDS:
        known.clear()
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(width, len(hashes))
    n = len(hashes) - size + 1
    found = np.full(n, size, np.uint64)
    for at in range(size):
        found = _mixed(found + hashes[at : at + n])
    return np.unique(found)


@lru_cache(maxsize=1)
def _multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = _mixed(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return numbers[:count] | np.uint64(1), numbers[count:]


def half_keys(sets: list[np.ndarray], half: int = HALF, side: int = SIDE) -> np.ndarray:
    """2 * side half keys for each of the sets, none of them empty."""
    times, plus = _multipliers(2 * side * half)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    values = np.concatenate(sets)
    least = np.empty((len(times), len(sets)), np.uint64)
    for i, (a, b) in enumerate(zip(times, plus, strict=True)):
        least[i] = np.minimum.reduceat(values * a + b, starts)
    keys = np.zeros((2 * side, len(sets)), np.uint64)
    for j in range(half):
        keys = _mixed(keys + least[j::half])
    return keys.T


@tidy(_word_hashes)
def _sign(batches: Batches, width: int) -> Batches:
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        stripe: list[tuple] = []
        size = 0
        for at, (doc_id, text) in enumerate(zip(ids, texts, strict=True)):
            found = shingle_set(text, width)
            stripe.append((doc_id, found))
            size += len(found)
            if size >= STRIPE or at == len(ids) - 1:
                yield _signed_rows(stripe)
                stripe, size = [], 0


def _signed_rows(stripe: list[tuple]) -> pa.RecordBatch:
    full = [s for _, s in stripe if len(s)]
    keys = iter(half_keys(full).view(np.int64).tolist() if full else [])
    columns = (
        [i for i, _ in stripe],
        [len(s) for _, s in stripe],
        [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for _, s in stripe],
        [next(keys) if len(s) else [] for _, s in stripe],
    )
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SIGNED, strict=True)], schema=_SIGNED)


@tidy(_word_hashes)
def _sets(batches: Batches, width: int) -> Batches:
    for batch in batches:
        sets = [shingle_set(t, width) for t in batch.column("text").to_pylist()]
        columns = ([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], [len(s) for s in sets], [s.view(np.int64) for s in sets])
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SETS, strict=True)], schema=_SETS)


def _similar(inter: Column, n: Column, m: Column, threshold: int) -> Column:
    return 100 * inter >= threshold * (n + m - inter)


def bucket_members(classes: DataFrame, side: int = SIDE) -> DataFrame:
    """(slot, key, cls) for the pairs of half keys that the class shares with others, one by one."""
    halves = classes.select("cls", F.posexplode("keys").alias("slot", "value"))
    shared = halves.groupBy("slot", "value").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    live = halves.join(shared, ["slot", "value"])
    of_class = live.groupBy("cls").agg(F.collect_list(F.struct("slot", "value")).alias("live"))  # at most 2 * side
    left = F.filter("live", lambda x: x["slot"] < side)
    right = F.filter("live", lambda x: x["slot"] >= side)
    return (
        of_class.select("cls", F.explode(left).alias("u"), right.alias("right"))
        .select("cls", "u", F.explode("right").alias("v"))
        .select("cls", (F.col("u.slot") * side + F.col("v.slot") - side).alias("slot"), F.xxhash64("u.value", "v.value").alias("key"))
    )


def _joining_links(rows: pa.Table, threshold: int, within: bool) -> list[tuple[bytes, bytes]]:
    """Pairs of labels with a verified link between their members; once two labels are joined, no further link between them."""
    labels, n = rows["label"].to_pylist(), rows["n"].to_numpy()
    left = rows["first"].to_numpy(zero_copy_only=False)
    lists = rows["shingles"].combine_chunks()
    owner = np.repeat(np.arange(len(labels)), np.diff(lists.offsets.to_numpy()))
    _, column, seen = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
    common = seen[column] > 1
    owner, column = owner[common], np.unique(column[common], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    inter = np.zeros((len(labels), len(labels)), np.float32)
    for start in range(0, int(column.max(initial=-1)) + 1, COLUMNS):
        low, high = np.searchsorted(column, [start, start + COLUMNS])
        dense = np.zeros((len(labels), COLUMNS), np.float32)
        dense[owner[low:high], column[low:high] - start] = 1
        inter += dense @ dense.T
    linked = 100 * inter >= threshold * (n[:, None] + n[None, :] - inter)
    linked &= np.triu(np.ones_like(linked), 1) if within else left[:, None] & ~left[None, :]
    above: dict[bytes, bytes] = {}

    def top(label: bytes) -> bytes:
        while above.get(label, label) != label:
            label = above[label]
        return label

    found = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        a, b = top(labels[i]), top(labels[j])
        if a != b:
            above[a] = b
            found.append((labels[i], labels[j]))
    return found


def _compare(key: tuple, rows: pa.Table, threshold: int) -> pa.Table:
    found = _joining_links(rows, threshold, key[1].as_py() == key[2].as_py())
    return pa.table([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], names=["a", "b"])


def _own_shingles(sets: DataFrame) -> DataFrame:
    """(cls, own): shingles that no other of these sets has."""
    single = sets.select("cls", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("k"), F.min("cls").alias("cls"))
    return single.where("k = 1").groupBy("cls").agg(F.count("*").alias("own"))


def _open_buckets(rows: DataFrame) -> DataFrame:
    """Rows (slot, key, cls, label) of the buckets that hold more than one label."""
    mixed = rows.groupBy("slot", "key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return rows.join(mixed.select("slot", "key"), ["slot", "key"])


def _round_links(rows: DataFrame) -> DataFrame:
    """(a, b, label_a, label_b): each class b of an open bucket with the smallest class that leads one of its buckets and has another label."""
    lead = rows.groupBy("slot", "key").agg(F.min(F.struct("cls", "label")).alias("lead"))
    other = rows.join(lead, ["slot", "key"]).where("label <> lead.label")
    least = other.groupBy(F.col("cls").alias("b"), F.col("label").alias("label_b")).agg(F.min("lead").alias("lead"))
    return least.select(F.col("lead.cls").alias("a"), "b", F.col("lead.label").alias("label_a"), "label_b")


def _verified(links: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links whose full sets are similar enough, as pairs (a, b) of labels; sizes are compared before sets are moved."""
    one, two = (sets.select(F.col("cls").alias(c), F.col("n").alias(f"n_{c}"), F.col("shingles").alias(f"s_{c}")) for c in "ab")
    inter = F.size(F.array_intersect("s_a", "s_b"))
    close = 100 * F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b")
    sized = links.join(one.select("a", "n_a"), "a").join(two.select("b", "n_b"), "b").where(close).select(links.columns)
    alike = sized.join(one, "a").join(two, "b").where(_similar(inter, F.col("n_a"), F.col("n_b"), threshold))
    return alike.select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct()


def _rest(rows: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) between the labels of classes of one open bucket that are not yet in one component."""
    for _ in range(2):  # a class that went may leave shingles of another without a partner
        asked = stage(rows.select("cls", "label").distinct().join(sets, "cls"), "asked")
        own = _own_shingles(asked)
        may = asked.join(own, "cls", "left").where(100 * F.coalesce("own", F.lit(0)) <= (100 - threshold) * F.col("n"))
        rows = stage(_open_buckets(rows.join(may.select("cls"), "cls", "left_semi")), "open")
    lowest = rows.groupBy("slot", "key").agg(F.min("cls").alias("a"))
    ties = rows.join(lowest, ["slot", "key"]).where("a <> cls").select("a", F.col("cls").alias("b")).distinct()
    clusters = components(ties)
    sizes = clusters.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = (
        clusters.join(sizes, "label")
        .select(F.col("node").alias("cls"), F.col("label").alias("cluster"), "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("own"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("cls", "cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("first"))
    )
    blocks = placed.join(asked, "cls").groupBy("cluster", "i", "j")
    return blocks.applyInArrow(lambda key, rows: _compare(key, rows, threshold), "a binary, b binary")


def _components_of_classes(texts: DataFrame, signed: DataFrame, threshold: int, width: int) -> DataFrame:
    """(cls, component_id) of all classes; component_id is the smallest id of the component."""
    classes = stage(
        signed.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("first"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys")),
        "classes",
    )
    with scratch(texts.sparkSession):
        pairs = stage(bucket_members(classes), "buckets")
        buckets = pairs.groupBy("slot", "key").agg(F.count("*").alias("n")).where("n > 1")
        members = stage(pairs.join(buckets, ["slot", "key"]).select("slot", "key", "cls", F.col("cls").alias("label")), "members", keep=True)
    with scratch(texts.sparkSession):
        met = stage(members.select("cls").distinct().join(classes, "cls").select("cls", "first"), "met")
        wanted = met.select(F.col("first").alias("doc_id")).distinct()
        again = texts.join(wanted, texts["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi")
        sets = again.select("text").mapInArrow(lambda b: _sets(b, width), _SETS_DDL)
        sets = stage(
            sets.join(met, "cls", "left_semi").groupBy("cls").agg(F.first("n").alias("n"), F.first("shingles").alias("shingles")), "sets", keep=True
        )
    labels, left = None, members
    for _ in range(ROUNDS):
        found = stage(_verified(_round_links(left), sets, threshold), "verified")
        # In the first round each class has one link, to a smaller one; then links join the components found so far.
        labels = roots(found) if labels is None else stage(merged(labels, components(found)), "labels")
        left = left.drop("label").join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
        left = stage(_open_buckets(left.select("slot", "key", "cls", "label")), "open")
    rest = stage(_rest(left, sets, threshold), "rest")
    if not rest.isEmpty():
        labels = merged(labels, components(rest))
    named = classes.select("cls", "first").join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "first", F.coalesce("label", "cls").alias("label"))
    named = stage(named, "named")
    lowest = named.groupBy("label").agg(F.min("first").alias("component_id"))
    return named.join(lowest, "label").select("cls", "component_id")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id reachable), kept; `threshold` in percent."""
    texts = docs.select(F.col(key).cast("long").alias("doc_id"), ascii_lower(text_of(text)).alias("text"))
    signed = stage(texts.mapInArrow(lambda b: _sign(b, width), _SIGNED_DDL), "signed")
    with scratch(docs.sparkSession):
        of_class = stage(_components_of_classes(texts, signed, threshold, width), "components", keep=True)
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return signed.join(of_class, "cls", "left").select(
        "doc_id", "n_shingles", F.coalesce(component, "doc_id").alias("component_id")
    ).withColumn("kept", F.col("component_id").eqNullSafe(F.col("doc_id")))
