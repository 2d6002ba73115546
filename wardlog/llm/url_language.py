"""URL filter by the ratio of two character language models.

Rules come first: the longest rule whose host is the url's host or a parent of it, and whose path starts the url's path,
decides. All other urls are judged by two variable-order Markov models over the characters of host and path, one of
accepted and one of rejected urls. A character's probability after its context of up to `ORDER` characters is
interpolated with the one after the next shorter context (Witten-Bell weights: a context that was followed by many
different characters trusts its own counts less); unseen contexts hand over to shorter ones.

Training urls are labelled by a boolean column of the caller, else by `REJECT_SEEDS` in the host. A hash of id and url
keeps a part of them out of the counts, so results don't depend on the files' layout; on these the cut of the length-normalised log-likelihood difference is set, with the cost of a wrongly blocked url `FALSE_BLOCK` times
that of a missed one. Counts are grouped aggregates over all pages; the models stay tables and are joined to the distinct
character windows, then windows to urls. Nothing but single rows of totals and the score histogram (at most
`BINS` + 1 rows) goes to the driver. Ratios are summed in fixed point, so scores don't depend on the order of rows.

Edge cases: a url that is null or has no `://` has an empty host and path, fits no rule, and is scored as the empty text.
Repeated urls and ids are judged row by row. Without rejected or without accepted training urls everything outside the
rules is allowed. An empty table gives an empty result. Long urls are scored whole. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlog.llm.common import ascii_lower
from wardlog.session import stage

#: Rules of the registered query, (host, path, verdict): fixed values.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Words that mark a host as unwanted when training urls are labelled.
REJECT_SEEDS = ("ads-", "adult", "bets", "casino", "cheap-", "free-", "gambl", "pills", "poker", "porn", "spam", "track")
ORDER = 4
#: Characters that an unseen one is drawn from.
ALPHABET = 256
#: One training url in so many calibrates the cut.
HELD_OUT = 5
FALSE_BLOCK = 10.0
#: The histogram of held-out scores reaches from -RANGE to RANGE.
RANGE, BINS = 8.0, 3_200
START, END = "\x02", "\x03"
#: Ratios are summed in units of 2^-RATIO_BITS.
RATIO_BITS = 32


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path up to the query; both empty without `://`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, outcome in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule, verdict = F.when(fits, rule_host + rule_path).otherwise(rule), F.when(fits, outcome).otherwise(verdict)
    return rule, verdict


def windows(rows: DataFrame, text: str = "judged") -> DataFrame:
    """Adds `gram`: one row per character, with the ORDER characters before it."""
    padded = F.concat(F.lit(START * ORDER), text, F.lit(END))
    places = F.sequence(F.lit(1), F.length(text) + 1)
    return rows.withColumn("gram", F.explode(F.transform(places, lambda i: F.substring(padded, i, F.lit(ORDER + 1)))))


def gram_ratios(grams: DataFrame) -> DataFrame:
    """(gram, ratio) from (gram, rejected, accepted) counts: log P(rejected) - log P(accepted) of the last character."""
    rows = grams.select("gram", F.lit(1.0 / ALPHABET).alias("p_rejected"), F.lit(1.0 / ALPHABET).alias("p_accepted"))
    sides = ("rejected", "accepted")
    for order in range(ORDER + 1):
        seen = grams.withColumn("own", F.substring("gram", ORDER + 1 - order, order + 1)).groupBy("own").agg(*[F.sum(s).alias(s) for s in sides])
        context = F.substring("own", 1, order)
        followed = seen.groupBy(context.alias("context")).agg(
            *[F.sum(s).alias(f"n_{s}") for s in sides], *[F.sum((F.col(s) > 0).cast("long")).alias(f"kinds_{s}") for s in sides]
        )
        rows = (
            rows.withColumn("own", F.substring("gram", ORDER + 1 - order, order + 1))
            .withColumn("context", F.substring("gram", ORDER + 1 - order, order))
            .join(seen, "own", "left")
            .join(followed, "context", "left")
        )
        mixed = [
            F.when(F.col(f"n_{s}") > 0, (F.col(s) + F.col(f"kinds_{s}") * F.col(f"p_{s}")) / (F.col(f"n_{s}") + F.col(f"kinds_{s}"))).otherwise(F.col(f"p_{s}")).alias(f"p_{s}")
            for s in sides
        ]
        rows = rows.select("gram", *mixed)
    return rows.select("gram", (F.log("p_rejected") - F.log("p_accepted")).alias("ratio"))


def calibrated_cut(scored: DataFrame) -> float:
    """The score with the least cost on labelled held-out rows (score, rejected); of equal ones the middle."""
    unit = 2 * RANGE / BINS
    place = F.floor((F.least(F.greatest("score", F.lit(-RANGE)), F.lit(RANGE)) + RANGE) / unit)
    bins = {r.place: (r.bad or 0, r.n) for r in scored.groupBy(place.alias("place")).agg(F.sum(F.col("rejected").cast("long")).alias("bad"), F.count("*").alias("n")).collect()}
    bad, good = sum(b for b, _ in bins.values()), sum(n - b for b, n in bins.values())
    if not bad or not good:
        return float("inf")
    missed, blocked = 0, good
    costs = []
    for at in range(BINS + 2):  # the cut lies at the lower edge of bin `at`
        costs.append(missed / bad + FALSE_BLOCK * blocked / good)
        b, n = bins.get(at, (0, 0))
        missed, blocked = missed + b, blocked - (n - b)
    best = [i for i, c in enumerate(costs) if c <= min(costs) + 1e-12]
    return (best[0] + best[-1]) / 2 * unit - RANGE


def judge(
    pages: DataFrame, rules: tuple = RULES, seeds: tuple = REJECT_SEEDS, key: str = "page_id", url: str = "url", rejected: Column | None = None
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score.

    `rejected` labels the training urls (true, false, or null for those to leave out) in place of `seeds`.
    """
    host, path = host_and_path(F.col(url).cast("string"))
    if rejected is None:
        rejected = F.when(host != "", F.exists(F.array(*map(F.lit, seeds)), lambda seed: host.contains(seed)))
    held = F.pmod(F.xxhash64(F.lit(5), F.col(key), F.col(url).cast("string")), F.lit(HELD_OUT)) == 0
    parsed = pages.select(
        F.col(key).alias("page_id"), host.alias("host"), path.alias("path"), rejected.alias("rejected"), held.alias("held"), F.monotonically_increasing_id().alias("row")
    )
    rows = stage(parsed.withColumn("judged", F.concat("host", ascii_lower(F.col("path")))), "urls")
    trained = (F.col("rejected").isNotNull() & ~F.col("held")).cast("long")
    grams = stage(
        windows(rows.select("judged", "rejected", "held")).groupBy("gram").agg(
            F.sum(trained * F.coalesce(F.col("rejected").cast("long"), F.lit(0))).alias("rejected"),
            F.sum(trained * F.coalesce(1 - F.col("rejected").cast("long"), F.lit(0))).alias("accepted"),
        ),
        "grams",
    )
    ratios = stage(gram_ratios(grams), "ratios")
    units = F.round(F.col("ratio") * F.lit(float(1 << RATIO_BITS))).cast("long")
    mean = F.sum(units) / F.count("*") / F.lit(float(1 << RATIO_BITS))
    sums = windows(rows.select("row", "judged")).join(ratios, "gram").groupBy("row").agg(mean.alias("score"))
    scored = stage(rows.join(sums, "row"), "scored")
    known = grams.agg(F.max("rejected").alias("bad"), F.max("accepted").alias("good")).first()
    cut = calibrated_cut(scored.where("held AND rejected IS NOT NULL")) if known.bad and known.good else float("inf")
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(ruled, F.when(F.col("score") >= cut, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "score")
