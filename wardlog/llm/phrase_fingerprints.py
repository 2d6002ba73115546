"""Collocations by Rabin-Karp fingerprints: phrases are hashed, counted and pointed at; only frequent ones become text.

Texts are laid out once as chunks of one language, A-Z lower-cased, with a line feed between pieces. Some chunks at a time
form a unit. Prefix polynomials over its bytes give the fingerprint of every word, and prefix polynomials over these the
fingerprint of every phrase, for all places at once. Equal fingerprints of a unit are compared word by word with the text
they stand for; what differs gets an entry of its own. An entry is (fingerprint, check, count, pointer to one occurrence).

Sizes are counted one after the other. A phrase can be frequent only if both phrases that lack its first or last word are,
so each size looks these up in a bit table of the frequent fingerprints of the size before. The table has 2^`FILTER_BITS`
bits whatever the corpus; a wrong bit lets more through and changes no result. Entries are shuffled as compressed runs of
neighbouring fingerprints, and each range of fingerprints is summed by itself.

Across units, phrases are one if the 64-bit fingerprint and a check agree, which is another polynomial, modulo a prime, over
the bytes of the words: 95 bits, so that colliding fingerprints part here. Only sums that reach the threshold keep a pointer;
it meets the chunk's bytes again and becomes text. Scores are exact decimals.

Edge cases: null text is the empty text, a null language is `und`. Texts of separators alone hold no words. Repeated rows
count each. A piece longer than a chunk is cut between words; the next chunk repeats the words that phrases reach back to
and counts no phrase that ends in them. One word is never cut. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardlog.llm.common import LOWER, UPPER, Batches, as_batch, bucket_count, text_of, tidy
from wardlog.session import stage

LONGEST, LEAST, TOP, COVERED = 3, 10, 2000, 50
#: Bytes of a chunk (small rows spare the JVM's heap), of the chunks counted together, and of all that a task keeps open.
CHUNK, UNIT, OPEN = 1 << 15, 1 << 22, 1 << 24
#: Bits of a pointer for the word's place in its chunk, and for the chunk's number in its partition.
PLACE_BITS, ROW_BITS = 20, 20
#: Bytes hashed and compared at a time.
STRIPE = 1 << 18
FILTER_BITS = 25
#: Ranges of fingerprints are at most 2^RANGE_BITS.
RANGE_BITS = 31

#: Piece breaks, blanks and letters of the contract as one table: fixed values.
_TABLE = bytes.maketrans(UPPER.encode() + b".,;:!?\x0b\x0c\x0d\t", LOWER.encode() + b"\n" * 9 + b" ")
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))

_CHUNKS = pa.schema([("lang", pa.string()), ("skip", pa.int32()), ("n", pa.int64()), ("words", pa.binary())])
_CHUNKS_DDL = "lang string, skip int, n long, words binary"
_RUNS = pa.schema([("part", pa.int32()), ("run", pa.binary())])
_RUNS_DDL = "part int, run binary"
_FOUND_DDL = "fp long, n long, pointer long"
#: Words of the corpus for each range of fingerprints, which one task sums at a time.
RANGE_WORDS = 1 << 21
#: Fields of an entry in a run and the prime and base of the check.
_FIELDS = (("fp", "<u8"), ("pointer", "<u8"), ("n", "<u4"), ("check", "<u4"))
_PRIME, _CHECK_BASE = (1 << 31) - 1, 1_103_515_245
_PHRASES = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])
_PHRASES_DDL = "lang string, size int, phrase string, n long"


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2^64, from the zeroth on."""
    if which not in _POWERS or len(_POWERS[which][0]) < n:
        base = int(_BASES[which])
        both = []
        for factor in (base, pow(base, -1, 1 << 64)):
            row = np.full(n, factor, np.uint64)
            row[:1] = 1
            both.append(np.cumprod(row))
        _POWERS[which] = (both[0], both[1])
    return _POWERS[which][0][:n], _POWERS[which][1][:n]


def _check_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the check's base and of its inverse modulo the prime, by doubling."""
    if 2 not in _POWERS or len(_POWERS[2][0]) < n:
        both = []
        for base in (_CHECK_BASE, pow(_CHECK_BASE, -1, _PRIME)):
            row = np.ones(1, np.uint64)
            while len(row) < n:
                row = np.concatenate([row, row * np.uint64(pow(base, len(row), _PRIME)) % np.uint64(_PRIME)])
            both.append(row)
        _POWERS[2] = (both[0], both[1])
    return _POWERS[2][0][:n], _POWERS[2][1][:n]


def polynomials(values: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix polynomials of a sequence, and the factors that move a difference of two to the place zero."""
    powers, inverse = _powers(which, len(values) + 1)
    prefix = np.zeros(len(values) + 1, np.uint64)
    np.multiply(values, powers[:-1], out=prefix[1:])
    np.cumsum(prefix, out=prefix)
    return prefix, inverse


def _edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a chunk."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = (data != 32) & (data != 10)
    change = np.diff(inside)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


class Words:
    """The words of a unit of chunks: places, pieces, fingerprints, and numbers that are equal exactly for equal words."""

    def __init__(self, parts: list[bytes], skips: list[int], bits: int = 64):
        self.data = np.frombuffer(b"\n".join(parts), np.uint8)
        self.starts, self.ends = _edges(self.data)
        begins = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]])
        self.part = np.searchsorted(begins, self.starts, "right") - 1
        self.local = np.arange(len(self.starts)) - np.searchsorted(self.starts, begins)[self.part]
        self.counts = self.local >= np.array(skips)[self.part]
        self.piece = np.searchsorted(np.flatnonzero(self.data == 10), self.starts)
        self.mask = np.uint64((1 << 64) - (1 << (64 - bits)))
        self.raw, self.checks, prime = np.zeros(len(self.starts), np.uint64), np.zeros(len(self.starts), np.uint64), np.uint64(_PRIME)
        for first, last in self._stripes():
            low = self.starts[first]
            prefix, inverse = polynomials(self.data[low : self.ends[last - 1]].astype(np.uint64) + np.uint64(1), 0)
            starts, ends = self.starts[first:last] - low, self.ends[first:last] - low
            self.raw[first:last] = _mixed((prefix[ends] - prefix[starts]) * inverse[starts]) & self.mask
            powers, inverse = _check_powers(len(prefix))
            np.cumsum((self.data[low : self.ends[last - 1]] + np.uint64(1)) * powers[:-1], out=prefix[1:])
            self.checks[first:last] = (prefix[ends] - prefix[starts]) % prime * inverse[starts] % prime
        self.numbers = self._numbers()

    def _stripes(self) -> list[tuple[int, int]]:
        """Runs of words that take about `STRIPE` bytes; a longer word has its own."""
        edges = np.unique(np.append(np.searchsorted(self.starts, np.arange(0, len(self.data), STRIPE)), len(self.starts)))
        return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))

    def _equal(self, kept: np.ndarray) -> bool:
        """Whether every word has the bytes of its representative."""
        lengths = self.ends - self.starts
        if not np.array_equal(lengths, lengths[kept]):
            return False
        for first, last in self._stripes():
            size = lengths[first:last]
            own = np.arange(size.sum()) + np.repeat(self.starts[first:last] - (np.cumsum(size) - size), size)
            other = own + np.repeat(self.starts[kept[first:last]] - self.starts[first:last], size)
            if not np.array_equal(self.data[own], self.data[other]):
                return False
        return True

    def _numbers(self) -> np.ndarray:
        _, first, numbers = np.unique(self.raw, return_index=True, return_inverse=True)
        if self._equal(first[numbers]):
            return numbers
        known: dict[bytes, int] = {}  # two words share a fingerprint
        whole = self.data.tobytes()
        return np.array([known.setdefault(whole[a:b], len(known)) for a, b in zip(self.starts, self.ends, strict=True)], np.int64)

    def fingerprints(self, size: int, language: int) -> np.ndarray:
        """Fingerprint of the phrase of `size` words from each word on that has so many words behind it."""
        prefix, inverse = polynomials(self.raw, 1)
        n = max(0, len(self.raw) - size + 1)
        plain = (prefix[size : size + n] - prefix[:n]) * inverse[:n]
        return _mixed(plain + np.uint64(language)) & self.mask

    def within(self, size: int) -> np.ndarray:
        """Whether the phrase from each word on stays in one piece and ends behind the repeated words."""
        n = max(0, len(self.raw) - size + 1)
        last = slice(size - 1, size - 1 + n)
        return (self.piece[:n] == self.piece[last]) & self.counts[last]

    def entries(self, size: int, places: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint, count and first place of each distinct phrase at the places; checked against the words."""
        values, first, group, counts = np.unique(found, return_index=True, return_inverse=True, return_counts=True)
        same = all(np.array_equal(self.numbers[places + k], self.numbers[places[first[group]] + k]) for k in range(size))
        if same:
            return values, counts, places[first]
        rows = np.column_stack([found.view(np.int64), *[self.numbers[places + k] for k in range(size)]])
        _, first, counts = np.unique(rows, axis=0, return_index=True, return_counts=True)
        return found[first], counts, places[first]


def packed(fields: dict[str, np.ndarray]) -> bytes:
    """Entries in the order of their fingerprints as one compressed run: differences, byte plane by byte plane."""
    columns = {**fields, "fp": np.diff(fields["fp"], prepend=np.uint64(0))}
    planes = [columns[name].astype(kind).view(np.uint8).reshape(-1, int(kind[2:])).T.tobytes() for name, kind in _FIELDS]
    size = len(fields["fp"])
    return size.to_bytes(4, "little") + pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def unpacked(run: bytes) -> dict[str, np.ndarray]:
    size = int.from_bytes(run[:4], "little")
    width = sum(int(kind[2:]) for _, kind in _FIELDS)
    planes = np.frombuffer(pa.decompress(run[4:], decompressed_size=size * width, codec="zstd", asbytes=True), np.uint8)
    found, at = {}, 0
    for name, kind in _FIELDS:
        bytes_ = int(kind[2:])
        found[name] = np.ascontiguousarray(planes[at : at + size * bytes_].reshape(bytes_, size).T).view(kind).ravel()
        at += size * bytes_
    found["fp"] = np.cumsum(found["fp"], dtype=np.uint64)
    return found


def _summed(rows: pa.Table, least: int) -> pa.Table:
    """Phrases of one range of fingerprints that reach the threshold."""
    runs = [unpacked(r.as_py()) for r in rows["run"]]
    every = {name: np.concatenate([r[name] for r in runs]) for name, _ in _FIELDS}
    del runs
    order = np.lexsort((every["check"], every["fp"]))
    fp, check = every["fp"][order], every["check"][order]
    starts = np.flatnonzero(np.concatenate([[True], (fp[1:] != fp[:-1]) | (check[1:] != check[:-1])]))
    n = np.add.reduceat(every["n"][order].astype(np.int64), starts)
    pointer = np.minimum.reduceat(every["pointer"][order].view(np.int64), starts)
    kept = n >= least
    return pa.table({"fp": fp[starts][kept].view(np.int64), "n": n[kept], "pointer": pointer[kept]})


def phrases_at(words: bytes, places: list[int], sizes: list[int]) -> list[str]:
    """The words of a chunk from each of the places on."""
    starts, ends = (x.tolist() for x in _edges(np.frombuffer(words, np.uint8)))
    return [b" ".join(words[starts[i] : ends[i]] for i in range(p, p + n)).decode() for p, n in zip(places, sizes, strict=True)]


def parts_of(words: bytes, longest: int, size: int) -> list[tuple[int, bytes]]:
    """Parts of about `size` bytes with the number of repeated words each begins with; cut at piece breaks if there are any."""
    parts, at, skip, fresh = [], 0, 0, 0
    while len(words) - at > size:
        end = words.rfind(b"\n", max(at, fresh), at + size)
        if end < 0:
            start = max(at, fresh)
            while words[start : start + 1] == b" ":
                start += 1
            end = words.rfind(b" ", start, at + size)
            if end < 0:
                ends = [e for e in (words.find(b" ", max(start, at + size)), words.find(b"\n", max(start, at + size))) if e >= 0]
                end = min(ends, default=len(words))
        parts.append((skip, words[at:end]))
        fresh, skip, low = end, 0, at
        at = end + 1
        if words[end : end + 1] == b" ":
            back = end
            while skip < longest - 1 and back > low:
                tail = back
                while tail > low and words[tail - 1] == 32:
                    tail -= 1
                back = max(words.rfind(b" ", low, tail), words.rfind(b"\n", low, tail)) + 1 or low
                back = max(back, low)
                if back == tail:
                    break
                at, skip = back, skip + 1
                if words[back - 1 : back] == b"\n":
                    break
    parts.append((skip, words[at:]))
    return [(s, p) for s, p in parts if p]


@tidy()
def _laid_out(batches: Batches, longest: int, size: int) -> Batches:
    """Chunks of (lang, text) rows."""
    buffers: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def flushed(lang: str) -> Batches:
        whole = b"\n".join(buffers.pop(lang))
        del sizes[lang]
        rows = []
        for skip, part in parts_of(whole, longest, size):
            n = len(_edges(np.frombuffer(part, np.uint8))[0]) - skip
            if n > 0:
                rows.append((lang, skip, n, part))
        if rows:
            yield as_batch(_CHUNKS, **dict(zip(_CHUNKS.names, zip(*rows, strict=True), strict=True)))

    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
            lang, words = lang.as_py(), text.as_buffer().to_pybytes().translate(_TABLE) if text.as_buffer() else b""
            buffers.setdefault(lang, []).append(words)
            sizes[lang] = sizes.get(lang, 0) + len(words) + 1
            if sizes[lang] >= UNIT:
                yield from flushed(lang)
            elif sum(sizes.values()) >= OPEN:
                yield from flushed(max(sizes, key=sizes.__getitem__))
    for lang in list(buffers):
        yield from flushed(lang)


def _language(lang: str) -> int:
    """A 64-bit number of a language, so that its phrases have fingerprints of their own."""
    data = np.frombuffer(lang.encode(), np.uint8).astype(np.uint64)
    return int(_mixed(polynomials(data + np.uint64(1), 0)[0][-1:])[0])


def _has(table: np.ndarray, found: np.ndarray) -> np.ndarray:
    slot = found >> np.uint64(64 - FILTER_BITS)
    return (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _units(batches: Batches) -> Iterator[tuple[str, list[tuple[int, int, bytes]]]]:
    """Language and (chunk, skip, words) of neighbouring chunks of one language, about `UNIT` bytes together."""
    lang, unit, size = "", [], 0
    for batch in batches:
        for row in zip(*(batch.column(c) for c in ("lang", "chunk", "skip", "words")), strict=True):
            now, *chunk = (x.as_py() for x in row)
            if unit and (now != lang or size >= UNIT):
                yield lang, unit
                unit, size = [], 0
            lang, size = now, size + len(chunk[-1])
            unit.append(tuple(chunk))
    if unit:
        yield lang, unit


@tidy()
def _counted(batches: Batches, size: int, table, bits: int, ranges: int) -> Batches:
    """Runs of entries of all phrases of one size whose shorter phrases are in the table."""
    for lang, unit in _units(batches):
        numbers, skips, parts = zip(*unit, strict=True)
        words, language = Words(list(parts), list(skips), bits), _language(lang)
        found, may = words.fingerprints(size, language), words.within(size)
        if table is not None and len(found):
            known = _has(table.value, words.fingerprints(size - 1, language))
            may &= known[: len(found)] & known[1 : len(found) + 1]
        places = np.flatnonzero(may)
        if not len(places):
            continue
        fp, n, first = words.entries(size, places, found[places])
        check = np.full(len(first), language, np.uint64)
        for k in range(size):
            check = _mixed(check + words.checks[first + k])
        pointer = (np.array(numbers)[words.part[first]] << PLACE_BITS) + words.local[first]
        fields = {"fp": fp, "pointer": pointer, "n": n, "check": check >> np.uint64(32)}
        part = (fp >> np.uint64(64 - RANGE_BITS)).astype(np.int64) * ranges >> RANGE_BITS
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        runs = [packed({name: x[a:b] for name, x in fields.items()}) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield as_batch(_RUNS, part=part[edges[:-1]], run=runs)


@tidy()
def _texts(batches: Batches) -> Batches:
    """Words at the pointers of a chunk, with their counts."""
    for batch in batches:
        for at in range(batch.num_rows):
            lang, found = batch.column("lang")[at].as_py(), batch.column("found")[at].values
            sizes = found.field("size").to_pylist()
            phrases = phrases_at(batch.column("words")[at].as_py(), found.field("place").to_pylist(), sizes)
            yield as_batch(_PHRASES, lang=[lang] * len(phrases), size=sizes, phrase=phrases, n=found.field("n"))


def _bit_table(frequent: DataFrame) -> np.ndarray:
    """Bits of the frequent fingerprints: at most 2^(FILTER_BITS - 6) rows of 64 bits, whatever the corpus."""
    slot = F.shiftrightunsigned("fp", 64 - FILTER_BITS)
    one = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(fp, {64 - FILTER_BITS}) & 63 as int))")
    rows = frequent.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(one).alias("bits")).toArrow()
    table = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    table[rows["at"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return table


def layout(docs: DataFrame, longest: int = LONGEST, size: int = CHUNK, text: str = "text", lang: str = "lang") -> DataFrame:
    """Staged chunks: chunk (number), lang, skip (repeated words), n (words that count), words."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_of(text).alias("text"))
    chunks = rows.mapInArrow(lambda batches: _laid_out(batches, longest, size), _CHUNKS_DDL)
    if size >= 2 << PLACE_BITS:
        raise ValueError("a chunk may hold more words than a pointer can name")
    number = F.monotonically_increasing_id()  # the partition above bit 33, the row below
    packed = F.shiftleft(F.shiftright(number, 33), ROW_BITS) + number.bitwiseAND(F.lit((1 << 33) - 1))
    return stage(chunks.withColumn("chunk", packed), "chunks")


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, chunk: int = CHUNK, bits: int = 64, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to `longest` words with at least `least` occurrences: (lang, size, phrase, f); and words of each lang: (lang, n)."""
    chunks = layout(docs, longest, chunk, text, lang)
    session = docs.sparkSession
    totals = chunks.groupBy("lang").agg(F.sum("n").alias("n"))
    ranges = min(1 << RANGE_BITS, bucket_count(totals.agg(F.sum("n")).first()[0] or 0, RANGE_WORDS))
    table, kept = None, []
    for size in range(1, longest + 1):
        runs = chunks.select("chunk", "lang", "skip", "words").mapInArrow(
            lambda batches, size=size, table=table: _counted(batches, size, table, bits, ranges), _RUNS_DDL
        )
        frequent = stage(runs.groupBy("part").applyInArrow(lambda rows: _summed(rows, least), _FOUND_DDL), f"frequent{size}")
        kept.append(frequent.select("pointer", "n", F.lit(size).alias("size")))
        if size < longest:
            table = session.sparkContext.broadcast(_bit_table(frequent))
    one = F.struct(F.col("pointer").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("place"), "size", "n")
    pointers = reduce(DataFrame.union, kept).groupBy(F.shiftright("pointer", PLACE_BITS).alias("chunk")).agg(F.collect_list(one).alias("found"))
    there = chunks.select("chunk", "lang", "words").join(pointers, "chunk").select("lang", "words", "found")
    phrases = there.mapInArrow(_texts, _PHRASES_DDL).groupBy("lang", "size", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    return stage(phrases, "phrases"), totals


def _joined(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(
    docs: DataFrame,
    longest: int = LONGEST,
    least: int = LEAST,
    top: int = TOP,
    covered: int = COVERED,
    chunk: int = CHUNK,
    bits: int = 64,
    text: str = "text",
    lang: str = "lang",
) -> DataFrame:
    """The `top` phrases of 2 to `longest` words of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase scores by its worst cut in two; it goes if a longer one that holds it has `covered` percent of its count.
    """
    phrases, totals = frequent_phrases(docs, longest, least, chunk, bits, text, lang)
    words = F.split("phrase", " ")
    several = phrases.where("size > 1")
    cuts = several.select("lang", "phrase", "size", F.col("f").alias("a"), words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", _joined(F.col("words"), F.lit(1), F.col("k")).alias("left"), _joined(F.col("words"), F.col("k") + 1, F.col("size") - F.col("k")).alias("right")
    )
    one, two = (phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)) for side, name in (("left", "l"), ("right", "r")))
    # Counts fit 16 digits, so products stay within 38; the quotient is at most 1,000,000.
    wide = {c: F.col(c).cast("decimal(16,0)") for c in "alr"}
    cuts = cuts.join(one, ["lang", "left"]).join(two, ["lang", "right"])
    cuts = cuts.withColumns({"up": wide["a"] * wide["a"] * F.lit(1000000).cast("decimal(7,0)"), "down": wide["l"] * wide["r"]})
    cuts = cuts.withColumn("score", F.expr("up div down"))
    worst = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    spans = [(start, length) for length in range(2, longest) for start in range(1, longest - length + 2)]
    inner = F.array(*[F.when(F.col("size") >= max(s + n - 1, n + 1), _joined(words, F.lit(s), F.lit(n))) for s, n in spans]) if spans else F.array().cast("array<string>")
    longer = phrases.where("size > 2").select("lang", "f", F.explode(F.array_compact(inner)).alias("phrase"))
    over = longer.groupBy("lang", "phrase").agg(F.max("f").alias("over"))
    left = worst.join(over, ["lang", "phrase"], "left").where(100 * F.coalesce("over", F.lit(0)) < covered * F.col("a"))
    scored = left.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
