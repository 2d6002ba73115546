"""Registered corpus queries, each applying its operator to a whole table, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlog.llm import (
    bit_slices,
    cuckoo_index,
    histogram_packing,
    importance_resample,
    language_fusion,
    learned_cuts,
    license_index,
    ownership_scan,
    phrase_fingerprints,
    source_schedule,
    tensored_minhash,
    unigram_counts,
    url_language,
)
from wardlog.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


@query
def op1_url_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all `pages` urls by rules and character language models."""
    return url_language.judge(table(spark, sf_dir, "pages"))


@query
def op2_source_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` mixed to 150 % of their words."""
    mixed = source_schedule.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op3_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn by importance weights of the good labelled ones."""
    return importance_resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence notices in all `documents`."""
    return license_index.scan(table(spark, sf_dir, "documents"))


@query
def op5_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of `documents` with similarity of at least 0.85 on five-word shingles."""
    return tensored_minhash.near_duplicates(table(spark, sf_dir, "documents"), threshold=85)


ORACLES["op5_tensored_minhash"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM w WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), e AS MATERIALIZED (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)
), sides AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (
  SELECT doc_id, doc_id AS seen FROM w UNION SELECT reach.doc_id, sides.b FROM reach JOIN sides ON sides.a = reach.seen
)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(seen) AS component_id, doc_id = min(seen) AS kept
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""


@query
def op6_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all `documents` from text, declaration and source."""
    return language_fusion.identify(table(spark, sf_dir, "documents"))


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of all `documents`."""
    return unigram_counts.token_counts(table(spark, sf_dir, "documents"))


@query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` in sequences of at most 2048 tokens."""
    return histogram_packing.pack(table(spark, sf_dir, "documents"))


@query
def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every twentieth vector of `embeddings`."""
    return bit_slices.search(table(spark, sf_dir, "embeddings"))


ORACLES["op9_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, a.r, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 20 = 0
), t AS (
  SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 20
"""


@query
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies of `documents` by the cuckoo-filter index."""
    return cuckoo_index.dedup(table(spark, sf_dir, "documents"))


ORACLES["op10_exact_dedup"] = r"""
WITH k AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM k GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k JOIN g USING (text_sha256)
"""


@query
def op11_learned_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` cut for fill-in-the-middle at lines found by the learned rank index."""
    cut = learned_cuts.fill_in_middle(table(spark, sf_dir, "documents"))
    restored = learned_cuts.restore(F.col("output"), F.col("form"))
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256")
    )


ORACLES["op11_learned_cuts"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), u AS (
  SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS l,
    [('0x' || h[1:8])::BIGINT, ('0x' || h[9:16])::BIGINT, ('0x' || h[17:24])::BIGINT, ('0x' || h[25:32])::BIGINT] AS g FROM d
), c AS (
  SELECT *, len(l) AS n, least(g[1] % (len(l) + 1), g[2] % (len(l) + 1)) AS a, greatest(g[1] % (len(l) + 1), g[2] % (len(l) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR g[3] % 100 >= 100 THEN 'plain'
      WHEN g[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u
), p AS (
  SELECT *, coalesce(array_to_string(l[1:a], ''), '') AS pre, coalesce(array_to_string(l[a + 1:b], ''), '') AS mid,
    coalesce(array_to_string(l[b + 1:n], ''), '') AS suf FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END)
    AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""


@query
def op12_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best 2,000 collocations of each language of all `documents`."""
    return phrase_fingerprints.collocations(table(spark, sf_dir, "documents"))


ORACLES["op12_phrase_fingerprints"] = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents
), w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
g AS MATERIALIZED (
  SELECT lang, s, g, count(*) AS f FROM (
    SELECT lang, s, unnest(list_transform(range(1, len(w) - s + 2), lambda i: array_to_string(w[i:i + s - 1], ' '))) AS g
    FROM (SELECT *, unnest(range(1, least(len(w), 3) + 1)) AS s FROM w)
  ) GROUP BY ALL
), n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE s = 1 GROUP BY lang),
c AS (SELECT lang, s, g, f, string_split(g, ' ') AS w FROM g WHERE s > 1 AND f >= 10),
h AS (
  SELECT lang, s, g, f, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, s)) AS k FROM c)
), k AS (
  SELECT h.lang, h.s, h.g, h.f, k, x.f AS l, y.f AS r, ((1000000::HUGEINT * h.f * h.f) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM h JOIN g x ON x.lang = h.lang AND x.g = h.x JOIN g y ON y.lang = h.lang AND y.g = h.y
), b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
long AS (
  SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS g, f FROM c WHERE s = 3
), gone AS (SELECT DISTINCT b.lang, b.g FROM b JOIN long USING (lang, g) WHERE 100 * long.f >= 50 * b.f),
t AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, encode(g)) AS rank, g AS phrase, f AS a, l, r, score
  FROM b ANTI JOIN gone USING (lang, g)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM t JOIN n USING (lang) WHERE rank <= 2000
"""


@query
def op13_ownership_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all `documents`; sources stand for owners, documents for repositories."""
    return ownership_scan.report(ownership_scan.scan(table(spark, sf_dir, "documents")))


def _ownership_sql() -> str:
    """The scan as SQL: matches are placed by the lengths of the pieces between them."""
    kinds = ownership_scan.BASE + ownership_scan.FORMATS
    each = " UNION ALL ".join(
        f"""SELECT row, doc_id, owner, {n} AS kind, '{k.name}' AS name, t, string_split_regex(t, '{k.pattern.replace("'", "''")}') AS p,
        regexp_extract_all(t, '{k.pattern.replace("'", "''")}', 0) AS m, regexp_extract_all(t, '{k.pattern.replace("'", "''")}', {k.group}) AS s, {k.least} AS least FROM d"""
        for n, k in enumerate(kinds)
    )
    base = len(ownership_scan.BASE)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents),
k AS ({each}),
i AS (SELECT * EXCLUDE (t), unnest(range(1, len(m) + 1)) AS i FROM k WHERE len(m) > 0),
f AS (
  SELECT row, doc_id, owner, kind, name, s[i] AS secret, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start,
    length(m[i]) AS size FROM i WHERE length(s[i]) >= least
), o AS (SELECT secret, count(DISTINCT owner) AS owners FROM f GROUP BY secret),
v AS (
  SELECT f.*, CASE WHEN owners >= {ownership_scan.COPIED_OWNERS} THEN 'copied'
    WHEN owners = 1 AND len(list_distinct(string_split(secret, ''))) >= {ownership_scan.LIVE_CHARS} AND regexp_matches(secret, '[0-9]') THEN 'live' ELSE 'open' END AS verdict
  FROM f JOIN o USING (secret)
), a AS (
  SELECT row, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(name || ':' || start::BIGINT || ':' || (start + size)::BIGINT, ',' ORDER BY start, kind) FILTER (kind < {base}) AS base,
    string_agg(name || ':' || start::BIGINT || ':' || (start + size)::BIGINT, ',' ORDER BY start, kind) AS spans,
    count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'copied') AS n_copied
  FROM v WHERE kind < {base} OR verdict = 'live' GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN a USING (row)
"""


ORACLES["op13_ownership_scan"] = _ownership_sql()
