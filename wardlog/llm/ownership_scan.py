"""Secret scan with corpus-wide ownership frequency, with DataFrame functions only.

Candidates of each kind are the leftmost non-overlapping matches of its pattern in the whole text. A match is placed by
the lengths of the pieces between the matches, summed up in two levels, so a text with a million matches stays linear but
for the block size. A candidate is known by the digest of its secret part alone; texts and secrets don't leave their row.

Each digest is counted over the corpus: in how many distinct repositories and how many distinct owners it occurs. A value
that many owners share is an example that was copied; a value that one owner has and that looks random is taken for live;
others stay open. Base kinds are reported whatever their verdict. The method's own kinds (public credential formats) are
reported where the verdict is `live`.

Counting takes distinct (digest, owner, repository) first, so a value that a third of all rows hold is counted in many
tasks; counts go back to the candidates by digest and salt, and only those of repeated values do so.

Edge cases: null and empty texts hold no spans; their joined spans are the empty text. Rows without an owner count as one
owner of their own, rows without a repository as one repository. Repeated rows get a row each and count once for owner and
repository. Places are code points. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlog.llm.common import text_of
from wardlog.session import stage


@dataclass(frozen=True)
class Kind:
    """A pattern, the group that holds the secret, its least length, and texts one of which every match holds."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0
    hints: tuple[str, ...] = ()


#: Base kinds: fixed values. Hints are in lower case and looked up in the lower-cased text.
BASE = (
    Kind(
        "assign",
        r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        1,
        6,
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
    ),
    Kind("access", r"AKIA[A-Z0-9]{16,}", 0, 20, ("akia",)),
    Kind("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: The method's own kinds: public credential formats, fixed values.
FORMATS = (
    Kind("forge", r"gh[pousr]_[A-Za-z0-9]{20,}", 0, 24, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Kind("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, ("xox",)),
    Kind("pay", r"[sr]k_live_[A-Za-z0-9]{16,}", 0, 24, ("k_live_",)),
    Kind("cloud", r"AIza[A-Za-z0-9_-]{30,}", 0, 34, ("aiza",)),
    Kind("signed", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28, ("eyj",)),
    Kind("bearer", r"[Bb]earer\x20+([A-Za-z0-9+/_.=-]{16,})", 1, 16, ("bearer",)),
    Kind("login", r"://[A-Za-z0-9._-]+:([A-Za-z0-9+/_.=!$%-]{6,})@", 1, 6, ("://",)),
)
#: From so many owners on a value counts as copied; a live value has at least so many distinct characters, a digit among them.
COPIED_OWNERS, LIVE_CHARS = 3, 8
#: Elements summed up in one fold, and salts of the counts of repeated values.
BLOCK, SALTS = 512, 16

_SPAN = "array<struct<start:long,end:long,digest:binary,odd:boolean>>"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running_sums(lengths: Column) -> Column:
    """Sums of all elements before each element: folds within blocks, shifted by a fold over the blocks."""
    zero = F.lit(0).cast("long")

    def before(values: Column, start: Column) -> Column:
        first = F.struct(start.alias("sum"), F.array().cast("array<long>").alias("all"))
        step = F.aggregate(
            values, first, lambda s, x: F.struct((s["sum"] + x).alias("sum"), F.concat(s["all"], F.array(s["sum"])).alias("all"))
        )
        return step["all"]

    def cut(values: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))
        return F.transform(numbers, lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))

    def shifted(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda block: F.aggregate(block, zero, lambda s, x: s + x))
        return F.flatten(F.zip_with(blocks, before(totals, zero), before))

    return bound(bound(lengths, cut), shifted)


def _spans(text: Column, low: Column, kind: Kind) -> Column:
    """Spans of one kind in a text; the patterns run only where a hint stands."""
    none = F.array().cast(_SPAN)
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    secrets = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(kind.group)) if kind.group else found
    # Pieces between the matches have one element more than the matches; it is paired with nulls.
    paired = F.arrays_zip(F.split(text, kind.pattern, -1), found, secrets)
    sized = F.transform(
        paired,
        lambda x: F.struct(F.length(x["0"]).cast("long").alias("piece"), F.coalesce(F.length(x["1"]), F.lit(0)).cast("long").alias("size"), x["2"].alias("secret")),
    )

    def span(x: Column, before: Column) -> Column:
        start, secret = before + x["piece"], x["secret"]
        odd = (F.size(F.array_distinct(F.split(secret, ""))) >= LIVE_CHARS) & secret.rlike("[0-9]")
        return F.when(
            F.length(secret) >= kind.least,
            F.struct(start.alias("start"), (start + x["size"]).alias("end"), F.unhex(F.sha2(secret, 256)).alias("digest"), odd.alias("odd")),
        )

    def place(rows: Column) -> Column:
        return F.array_compact(F.zip_with(rows, running_sums(F.transform(rows, lambda x: x["piece"] + x["size"])), span))

    here = F.lit(not kind.hints)
    for hint in kind.hints:
        here = here | low.contains(hint)
    return F.when(here, F.when(text.rlike(kind.pattern), bound(sized, place)).otherwise(none)).otherwise(none).cast(_SPAN)


def candidates(docs: DataFrame, kinds: tuple[Kind, ...] = BASE + FORMATS, key: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """One row per text: row, doc_id, owner, repository, found (array of kind number, start, end, digest, odd)."""
    rows = docs.select(
        F.col(key).alias("doc_id"),
        F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"),
        text_of(text).alias("text"),
        F.lower(text_of(text)).alias("low"),
    )

    def numbered(number: int, kind: Kind) -> Column:
        return F.transform(_spans(F.col("text"), F.col("low"), kind), lambda s: F.struct(F.lit(number).alias("kind"), s["start"], s["end"], s["digest"], s["odd"]))

    each = [numbered(number, kind) for number, kind in enumerate(kinds)]
    return rows.select("doc_id", "owner", "repository", F.concat(*each).alias("found")).withColumn("row", F.monotonically_increasing_id())


def ownership(found: DataFrame) -> DataFrame:
    """(digest, owners, repositories) of candidates (digest, owner, repository)."""
    homes = found.select("digest", "owner", "repository").distinct()
    per_owner = homes.groupBy("digest", "owner").agg(F.count("*").alias("homes"))
    return per_owner.groupBy("digest").agg(F.count("*").alias("owners"), F.sum("homes").alias("repositories"))


def judged_spans(rows: DataFrame, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """One row per candidate of staged `candidates`: row, kind, start, end, owners, repositories, verdict."""
    flat = rows.select("row", "owner", "repository", F.explode("found").alias("s")).select(
        "row", "owner", "repository", "s.kind", "s.start", "s.end", "s.digest", "s.odd"
    )
    salted = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    shared = ownership(flat).where("owners > 1 OR repositories > 1").withColumn("salt", salted)
    place = F.pmod(F.xxhash64("row", "start", "kind"), F.lit(SALTS)).cast("int")
    joined = flat.withColumn("salt", place).join(shared, ["digest", "salt"], "left")
    owners = F.coalesce("owners", F.lit(1).cast("long"))
    verdict = F.when(owners >= copied_owners, "copied").when((owners == 1) & F.col("odd"), "live").otherwise("open")
    return joined.select("row", "kind", "start", "end", owners.alias("owners"), F.coalesce("repositories", F.lit(1).cast("long")).alias("repositories"), verdict.alias("verdict"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id", formats: tuple[Kind, ...] = FORMATS, copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """One row per text: doc_id and spans, an array of (start, kind number, kind, end, owners, repositories, verdict, base).

    Base spans are always in it; spans of `formats` where their value belongs to one owner and looks live. The array is
    ordered by start and kind.
    """
    kinds = BASE + tuple(formats)
    rows = stage(candidates(docs, kinds, key, text, owner, repository), "candidates")
    judged = judged_spans(rows, copied_owners)
    names = F.array(*[F.lit(k.name) for k in kinds])
    kept = judged.where((F.col("kind") < len(BASE)) | (F.col("verdict") == "live"))
    one = F.struct("start", "kind", F.get(names, F.col("kind")).alias("name"), "end", "owners", "repositories", "verdict", (F.col("kind") < len(BASE)).alias("base"))
    spans = kept.groupBy("row").agg(F.array_sort(F.collect_list(one)).alias("spans"))  # the spans of one text
    joined = rows.select("row", "doc_id").join(spans, "row", "left")
    none = F.array().cast(spans.schema["spans"].dataType)
    return joined.select("doc_id", F.coalesce("spans", none).alias("spans"))


def joined(spans: Column) -> Column:
    """`kind:start:end` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")


def report(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied of scanned texts."""
    def number(field: str, value: str) -> Column:
        return F.size(F.filter("spans", lambda s: s[field] == value)).cast("long")

    base = F.filter("spans", lambda s: s["base"])
    return scanned.select(
        "doc_id",
        *[number("name", k.name).alias(f"n_{k.name}") for k in BASE],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        number("verdict", "live").alias("n_live"),
        number("verdict", "copied").alias("n_copied"),
    )
