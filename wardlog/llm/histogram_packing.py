"""Best-fit packing planned on the histogram of lengths.

Texts are tokenized once inside their tasks, a block at a time, and cut into pieces of at most `MAX_LENGTH` ids; a piece row carries its
length and checksum, not its ids, and is written to the shared folder. Only the number of pieces of each length (at
most `MAX_LENGTH` rows, whatever the corpus) goes to the driver. Best-fit decreasing runs on these counts: sequences
that look alike form one interval of sequence numbers, and a step gives one length to a whole interval at once, or
splits it when pieces run out. The plan is a list of (length, ranks, sequence interval, offset); each piece then takes
its slot by joining its rank within its length. The plan's size depends on `MAX_LENGTH` alone, so it is broadcast.

Ranks are numbered in many buckets per length and shifted by the counts before each bucket, so that a length that a
third of all pieces share is no task of its own.

Edge cases: null text is the empty text, whose ids are the end mark alone. Repeated rows and null ids are pieces like
any other. An empty table gives no pieces. Texts of any length are read whole. Extra columns are not read.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardlog.llm.common import Batches, as_batch, bucket_count, text_of, tidy, words_of
from wardlog.session import stage

MAX_LENGTH = 2048
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
#: Bytes of text that are cut at once, and of the units whose ids a worker keeps as arrays.
BLOCK_BYTES = 2 << 20
KEPT_BYTES = 12 << 20
#: Bytes of the words whose ids are kept one by one, and the longest word that is kept.
CACHED_BYTES = 24 << 20
CACHED_CHARS = 48
#: What an entry takes besides its characters and ids: the heads of two objects and a place in the table.
ENTRY_BYTES = 130
#: Marks of words seen once, by hash: a word is kept from its second sight on, so that rare ones don't displace others.
MARKS = 1 << 18
#: Pieces in a bucket in which ranks are numbered by one sort.
RANK_ROWS = 16_384

_PIECES = pa.schema(
    [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
)
_PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN_DDL = "length long, rank_from long, rank_to long, sequence_from long, copies long, at long"


#: Texts of these characters alone are cut by PRETOKENS; NFC leaves them as they are and lower case is one to one.
PLAIN = re.compile("[\\x09-\\x0D\\x20-\\x7EÀ-ÖØ-öø-ÿ]*")
#: The vocabulary's own rule for cutting lower-cased text, written for the characters of PLAIN: fixed value.
PRETOKENS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\sa-z0-9ß-öø-ÿ]+")
#: Stands before words for the whole tokenizer; no pretoken of PLAIN holds it.
ODD = "\0"
#: White space of `words_of`.
BLANK = re.compile(r"[\x20\x09-\x0D]")


class WordIds(dict):
    """Ids of lower-cased words as little-endian bytes, filled by the library's model and emptied by halves.

    A word lies between white space, which no pretoken holds. One of several pretokens is joined from theirs, which are
    words too; so a known word costs one look-up, whatever stands around its letters.
    """

    def __init__(self, vocabulary: str):
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        super().__init__()
        self.older: dict[str, bytes] = {}
        self.filled = 0
        self.seen = bytearray(MARKS)
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.model = self.tokenizer.model
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        as_letters = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        #: The model's letters for the bytes of each character of PLAIN beyond ASCII.
        self.letters = {c: as_letters(chr(c))[0][0] for c in range(0xC0, 0x100) if PLAIN.fullmatch(chr(c))}

    def cut(self, token: str) -> bytes:
        """Ids of one pretoken by the library's model."""
        found = self.model.tokenize(token if token.isascii() else token.translate(self.letters))
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def whole(self, word: str) -> bytes:
        """Ids of a word that holds other characters or special tokens, by the whole tokenizer."""
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            tokens = PRETOKENS.findall(word)
            ids = self.cut(word) if len(tokens) == 1 else b"".join(map(self.__getitem__, tokens))
            mark = hash(word) % MARKS
            if not self.seen[mark]:
                self.seen[mark] = 1
                return ids
        if len(word) <= CACHED_CHARS:
            if self.filled >= CACHED_BYTES // 2:
                self.older, self.filled = dict(self), 0
                self.clear()
                self.seen = bytearray(MARKS)
            self.filled += ENTRY_BYTES + len(word) + len(ids)
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text. Other characters and special tokens go through the whole tokenizer, word by word: no
        token of this vocabulary spans white space."""
        if PLAIN.fullmatch(text) and not any(s in text for s in self.specials):
            return b"".join(map(self.__getitem__, text.lower().split()))
        parts = []
        for word in words_of(text):
            if PLAIN.fullmatch(word) and not any(s in word for s in self.specials):
                parts.append(self[word.lower()])
            else:
                parts.append(self.whole(word))
        return b"".join(parts)


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places of runs laid end to end."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class BlockIds:
    """Ids of many texts at once: each distinct word of a block is cut once, each unit new to the worker is looked up once.

    A unit is a pretoken or, behind the mark `ODD`, a word for the whole tokenizer. Units and ids lie in arrays, about 35 bytes
    each; when `KEPT_BYTES` are full, those of the present block stay.
    """

    def __init__(self, vocabulary: str):
        self.words = WordIds(vocabulary)
        self.plain = f"^{PLAIN.pattern}$"
        self.tokens = f"({PRETOKENS.pattern})".replace(r"\s", r"\x09-\x0D\x20")
        self.units, self.bounds, self.ids = pa.array([], pa.string()), np.zeros(1, np.int64), np.zeros(0, "<u4")

    def _places(self, units: pa.Array) -> np.ndarray:
        """Places of distinct units among the kept ones; new ones are looked up and kept."""
        if self.units.nbytes + self.bounds.nbytes + self.ids.nbytes > KEPT_BYTES:
            held = pc.is_in(self.units, value_set=units).to_numpy(zero_copy_only=False)
            sizes = np.diff(self.bounds)[held]
            self.ids = self.ids[_runs(self.bounds[:-1][held], sizes)]
            self.units, self.bounds = self.units.filter(pa.array(held)), np.concatenate([[0], np.cumsum(sizes)])
        places = pc.fill_null(pc.index_in(units, value_set=self.units), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = places < 0
        if new.any():
            fresh = units.filter(pa.array(new))
            texts = fresh.to_numpy(zero_copy_only=False).tolist()
            cut = [self.words.whole(t[1:]) if t[:1] == ODD else self.words.cut(t) for t in texts]
            sizes = np.fromiter(map(len, cut), np.int64, len(cut)) // 4
            places[new] = np.arange(len(self.units), len(self.units) + len(texts))
            self.units = pa.concat_arrays([self.units, fresh])
            self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(cut), "<u4")])
        return places

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, end to end, and the number of each."""
        odd = pc.invert(pc.match_substring_regex(words, self.plain))
        for special in self.words.specials:
            odd = pc.or_(odd, pc.match_substring(words, special))
        apart = pc.replace_substring_regex(pc.utf8_lower(words), self.tokens, r"\1 ")
        split = pc.ascii_split_whitespace(pc.ascii_rtrim_whitespace(pc.if_else(odd, pc.binary_join_element_wise(ODD, words, ""), apart)))
        units = split.flatten().dictionary_encode()
        at = self._places(units.dictionary)[units.indices.to_numpy()]
        sizes = np.diff(self.bounds)[at]
        before = np.concatenate([[0], np.cumsum(sizes)])
        return self.ids[_runs(self.bounds[:-1][at], sizes)], np.diff(before[split.offsets.to_numpy()])

    def _of_block(self, texts: list[str]) -> list[bytes]:
        split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pa.array(texts, pa.string())))
        words = split.flatten().dictionary_encode()
        if not len(words):
            return [b""] * len(texts)
        ids, sizes = self._of_words(words.dictionary)
        starts, at = np.cumsum(sizes) - sizes, words.indices.to_numpy()
        sizes = sizes[at]
        before = np.concatenate([[0], np.cumsum(sizes)])[split.offsets.to_numpy()].tolist()
        found = ids[_runs(starts[at], sizes)]
        pa.default_memory_pool().release_unused()  # else the pool holds on to what the largest block took
        return [found[a:b].tobytes() for a, b in zip(before, before[1:])]

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """Ids of each text, in blocks of about `BLOCK_BYTES`; a longer text is cut at white space."""
        block, filled = [], 0
        for text in texts:
            if len(text) > BLOCK_BYTES:
                yield from self._of_block(block)
                block, filled = [], 0
                yield b"".join(self._of_block([part])[0] for part in parts_of(text, BLOCK_BYTES))
                continue
            block.append(text)
            filled += len(text)
            if filled >= BLOCK_BYTES:
                yield from self._of_block(block)
                block, filled = [], 0
        yield from self._of_block(block)


def parts_of(text: str, longest: int) -> Iterator[str]:
    """Parts of a text, cut at the first white space after so many characters."""
    at = 0
    while at < len(text):
        blank = BLANK.search(text, at + longest)
        end = blank.start() if blank else len(text)
        yield text[at:end]
        at = end


@lru_cache(maxsize=2)
def _block_ids(vocabulary: str) -> BlockIds:
    return BlockIds(vocabulary)


@tidy(kept=(_block_ids,))
def _cut(batches: Batches, vocabulary: str, longest: int) -> Batches:
    """Pieces of each (doc_id, text) row: length and checksum of the ids."""
    known, end = _block_ids(vocabulary), np.array([END_ID], "<u4").tobytes()
    for batch in batches:
        out: list[tuple] = []
        texts = (text.as_py() for text in batch.column("text"))
        for doc_id, found in zip(batch.column("doc_id").to_pylist(), known.encode(texts), strict=True):
            ids = found + end
            for piece, at in enumerate(range(0, len(ids), 4 * longest)):
                part = ids[at : at + 4 * longest]
                out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
        if out:
            yield as_batch(_PIECES, **dict(zip(_PIECES.names, zip(*out, strict=True), strict=True)))


def pieces_of(docs: DataFrame, vocabulary: str = VOCABULARY, longest: int = MAX_LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("text"))
    return rows.mapInArrow(lambda batches: _cut(batches, vocabulary, longest), _PIECES_DDL)


def plan_best_fit(counts: dict[int, int], capacity: int = MAX_LENGTH) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing on counts: rows of PLAN_DDL.

    Ranks from rank_from up to rank_to of a length go to sequences from sequence_from on, `copies` to each, the first at
    offset `at`.
    """
    plan: list[tuple[int, int, int, int, int, int]] = []
    open_: dict[int, list[tuple[int, int]]] = {}  # space left -> intervals of sequences (first, number)
    spaces: list[int] = []  # keys of open_, ascending
    sequences = 0

    def put(space: int, first: int, number: int) -> None:
        if space and number:
            if space not in open_:
                open_[space] = []
                bisect.insort(spaces, space)
            open_[space].append((first, number))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, number = open_[space].pop()
                if not open_[space]:
                    del open_[space], spaces[at]
                used, copies = min(left, number), 1
                put(space, first + used, number - used)
            else:
                space, first = capacity, sequences
                copies = min(left, capacity // length)
                used = left // copies
                sequences += used
            plan.append((length, rank, rank + used * copies, first, copies, capacity - space))
            put(space - copies * length, first, used)
            rank, left = rank + used * copies, left - used * copies
    return plan


def numbered(rows: DataFrame, key: str, unique: str, total: int, name: str = "rank") -> DataFrame:
    """Ranks from 0 within `key`, numbered per bucket and shifted by the counts of the buckets before."""
    buckets = bucket_count(total, RANK_ROWS)
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(unique), F.lit(buckets)))
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = rows.groupBy(key, "_bucket").agg(F.count("*").alias("_n")).select(
        key, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_shift")
    )
    inside = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(unique))
    return rows.withColumn("_inside", inside).join(shifts, [key, "_bucket"]).withColumn(
        name, F.col("_shift") + F.col("_inside") - 1
    ).drop("_bucket", "_inside", "_shift")


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, longest: int = MAX_LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = stage(pieces_of(docs, vocabulary, longest, key, text).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = F.broadcast(spark.createDataFrame(plan_best_fit(counts, longest), PLAN_DDL))
    ranked = numbered(pieces, "length", "_row", sum(counts.values()))
    slot = (ranked["length"] == plan["length"]) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    step = F.col("rank") - F.col("rank_from")
    return ranked.join(plan, slot).select(
        "doc_id",
        "piece",
        "start",
        ranked["length"],
        "ids_crc32",
        (F.col("sequence_from") + F.floor(step / F.col("copies"))).alias("sequence_id"),
        (F.col("at") + step % F.col("copies") * ranked["length"]).alias("offset"),
    )
