import math
import random
import weakref
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from wardlog.llm import bit_slices as bs
from wardlog.llm import language_fusion as lf
from wardlog.llm import queries as corpus
from wardlog.llm import source_schedule
from wardlog.llm import url_language as ul
from wardlog.llm.common import ARROW_BYTES, prepare, table

VECTOR = "vec_id long, embedding array<float>, label string, q string, block int"


def brute_top(rows, k=20):
    whole = []
    for i, v, *_ in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, [math.floor(64 * float(np.float32(x))) for x in v]))
    out = Counter()
    for n, (i, q) in enumerate(whole):
        if i is not None and i % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, c)), j is None, j or 0) for m, (j, c) in enumerate(whole) if m != n)[:k]
            out.update((i, rank, None if unnamed else j, -s) for rank, (s, unnamed, j) in enumerate(scores, 1))
    return out


def vector_rows():
    rng = random.Random(1)
    rows = [(i, [rng.choice([rng.gauss(0, 0.2), 0.25]) for _ in range(8)], "x", "y", 0) for i in range(400)]
    rows += [(20, [0.25] * 8, "x", "y", 0)] * 3 + [(i, [0.5] * 8, "x", "y", 0) for i in range(500, 540)]
    rows += [(40, None, None, None, None), (60, [None] * 8, "", "", 0), (80, [float("nan")] * 8, "", "", 0)]
    return rows + [(100, [float("inf")] * 8, "", "", 0), (None, [0.1] * 8, "", "", 0), (120, [0.5, -0.5], "", "", 0), *[(None, [0.5] * 8, "", "", 0)] * 3, (140, [3e4] * 8, "", "", 0)]


def test_top_k_is_exact(spark, monkeypatch):
    rows = vector_rows()
    df = prepare(spark).createDataFrame(rows, VECTOR)
    assert Counter(tuple(r) for r in bs.search(df).select("query_id", "rank", "vec_id", "score").collect()) == brute_top(rows)
    monkeypatch.setattr(bs, "BLOCK_ROWS", 64)
    monkeypatch.setattr(bs, "LEAST_QUERIES", 4)
    assert Counter(tuple(r) for r in bs.search(df).collect()) == brute_top(rows)
    assert bs.search(df.limit(0)).count() == 0
    few = df.where("vec_id IN (0, 3)")
    assert [(r.query_id, r.vec_id) for r in bs.search(few).collect()] == [(0, 3)]
    unnamed = spark.createDataFrame([(0, [1.0]), (None, [2.0]), (1, [1.0])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id, r.score) for r in bs.search(unnamed).orderBy("rank").collect()] == [(1, None, 8192), (2, 1, 4096)]


def test_bitmap_sums_equal_products():
    rng = np.random.default_rng(2)
    matrix = rng.integers(-40, 90, (333, 11))
    block = bs.SlicedBlock(np.arange(333), matrix)
    for query in rng.integers(-70, 70, (20, 11)):
        places, scores = block.top(query, 333)
        assert len(places) == 333 and (scores == matrix[places] @ query).all() and (np.diff(scores) <= 0).all()


PAGE = "page_id long, url string, html string, host string, row int, score double"
URLS = [None, "", "no address", "http://", "https://A.Example.NET/en/x?y#z", "http://example.net", "http://notexample.net/en/", "http://x.org/fr/1"]
URLS += ["http://www.example.com/de/1#x", "http://example.com/en/de/", "ftp://net/a", "x://y.net?q=/en/", "http://a.b/" + "p" * 5000, "http://ä.org/fr/"]


def page_rows():
    rng = random.Random(3)
    hosts = ["www.north.example.org", "north.example.org", "blog.river.example.com", "tree.example.com", "casino-win.example.org", "spam-hut.example.com"]
    urls = [f"http://{rng.choice(hosts)}/en/{rng.randrange(999)}" for _ in range(300)] + URLS + URLS
    return [(i if i % 50 else None, u, None, "x", 0, 0.0) for i, u in enumerate(urls)]


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:at], rest[at:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:end]


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in ul.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_url_rules_and_verdicts(spark):
    rows = page_rows()
    got = ul.judge(prepare(spark).createDataFrame(rows, PAGE)).collect()
    want = Counter((i, *plain_parts(u), plain_rule(*plain_parts(u))[0]) for i, u, *_ in rows)
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == want
    for r in got:
        ruled = plain_rule(r.host, r.path)[1]
        if ruled:
            assert r.verdict == ruled
        elif r.host and len(r.path) < 99:
            assert r.verdict == ("block" if "casino" in r.host or "spam" in r.host else "allow"), r
    assert ul.judge(spark.createDataFrame([], PAGE)).count() == 0
    allowed = ul.judge(spark.createDataFrame([(1, "http://a.example.org/x", None, "", 0, 0.0)], PAGE)).first()
    assert allowed.verdict == "allow"


def test_url_scores_and_cut_equal_a_plain_run(spark):
    """Held-out urls, counts, scores, cut and verdicts against a direct computation; other layouts and labels by the caller."""
    rows = [r for r in page_rows() if r[1] is None or len(r[1]) < 99]
    df = prepare(spark).createDataFrame(rows, PAGE)
    named = [F.xxhash64(F.lit(5), "page_id", "url").alias("hash"), "page_id", "url"]
    counts, known = {True: Counter(), False: Counter()}, []
    for h, i, u in df.select(*named).collect():
        host, path = plain_parts(u)
        text = host + "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in path)
        padded = ul.START * ul.ORDER + text + ul.END
        grams = [padded[j : j + ul.ORDER + 1] for j in range(len(text) + 1)]
        bad = None if host == "" else any(s in host for s in ul.REJECT_SEEDS)
        known.append((i, u, host, path, bad, h % ul.HELD_OUT == 0, grams))
        if bad is not None and h % ul.HELD_OUT:
            counts[bad].update(g[ul.ORDER - o :] for g in grams for o in range(ul.ORDER + 1))
    after = {bad: Counter() for bad in counts}
    kinds = {bad: Counter(g[:-1] for g in c) for bad, c in counts.items()}
    for bad, c in counts.items():
        for g, n in c.items():
            after[bad][g[:-1]] += n

    def chance(bad, gram):
        p = 1 / ul.ALPHABET
        for own in (gram[at:] for at in range(ul.ORDER, -1, -1)):
            if n := after[bad][own[:-1]]:
                p = (counts[bad][own] + kinds[bad][own[:-1]] * p) / (n + kinds[bad][own[:-1]])
        return math.log(p)

    scores = [sum(chance(True, g) - chance(False, g) for g in grams) / len(grams) for *_, grams in known]
    held = [(s, bad) for s, (*_, bad, out, _) in zip(scores, known) if out and bad is not None]
    cut = ul.calibrated_cut(spark.createDataFrame(held, "score double, rejected boolean"))
    assert 0 < sum(bad for _, bad in held) < len(held)

    def results(found):
        return sorted(((r.page_id is None, r.page_id or 0, r.host, r.path, r.verdict), r.score) for r in found.collect())

    want = []
    for score, (i, _, host, path, *_) in zip(scores, known):
        verdict = plain_rule(host, path)[1] or ("block" if score >= cut else "allow")
        want.append(((i is None, i or 0, host, path, verdict), score))
    got = results(ul.judge(df))
    assert [g[0] for g in got] == [w[0] for w in sorted(want)]
    assert [g[1] for g in got] == pytest.approx([w[1] for w in sorted(want)], abs=1e-7)
    assert results(ul.judge(df.repartition(7, "url"))) == got
    own = F.when(F.col("url").contains("://"), F.col("url").rlike("casino|spam"))
    named_host = [g for g in got if g[0][2]]
    assert [g[0] for g in results(ul.judge(df, rejected=own)) if g[0][2]] == [g[0] for g in named_host]


def test_url_model_by_hand(spark):
    """Interpolated probabilities of a few windows against a direct recursion."""
    rng = random.Random(4)
    texts = [("".join(rng.choice("ab./") for _ in range(rng.randrange(1, 9))), bool(rng.randrange(2))) for _ in range(60)]
    rows = ul.windows(prepare(spark).createDataFrame(texts, "judged string, rejected boolean"))
    grams = rows.groupBy("gram").agg(F.sum(F.col("rejected").cast("long")).alias("rejected"), F.sum((~F.col("rejected")).cast("long")).alias("accepted"))
    counts = {True: Counter(), False: Counter()}
    for text, bad in texts:
        padded = ul.START * ul.ORDER + text + ul.END
        for i in range(len(text) + 1):
            for order in range(ul.ORDER + 1):
                counts[bad][order, padded[i + ul.ORDER - order : i + ul.ORDER + 1]] += 1

    def chance(bad, gram):
        p = 1 / ul.ALPHABET
        for order in range(ul.ORDER + 1):
            own = gram[ul.ORDER - order :]
            after = {k[1]: n for k, n in counts[bad].items() if k[0] == order and k[1][:-1] == own[:-1]}
            if after:
                p = (after.get(own, 0) + len(after) * p) / (sum(after.values()) + len(after))
        return p

    for r in ul.gram_ratios(grams).collect():
        assert r.ratio == pytest.approx(math.log(chance(True, r.gram)) - math.log(chance(False, r.gram)))


def test_calibrated_cut(spark):
    rows = [(-2.0 - i / 50, False) for i in range(50)] + [(1.0 + i / 50, True) for i in range(10)]
    cut = ul.calibrated_cut(spark.createDataFrame(rows, "score double, rejected boolean"))
    assert -2 < cut < 1
    assert ul.calibrated_cut(spark.createDataFrame(rows[:5], "score double, rejected boolean")) == math.inf


def test_pipeline_stages_on_odd_rows(spark, docs_of, odd_rows, tmp_path):
    text = "the house of the people was in the town and they went with all that they had "
    rows = odd_rows + [(100 + i, text * 3 + f"to be there this evening {i // 2}", "en", "a") for i in range(6)]
    docs = docs_of(rows, clash=True)
    columns = docs.columns
    sizes = []
    for n, (name, work) in enumerate(corpus_pipeline.STAGES):
        docs = work(spark, docs, "")
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        sizes.append(sorted(r[0] for r in docs.select("doc_id").where("doc_id IS NOT NULL").collect()))
        if n < 4:
            assert docs.columns == columns
    assert sizes[0] == [1, 1, 2, 6, 7, 9, *range(100, 106)]
    assert sizes[1] == [1, 6, 7, 9, 100, 102, 104]
    assert sizes[2] == [1, 6, 9, 100]
    assert set(sizes[3]) <= set(sizes[2]) and all(sizes[3].count(i) <= 2 for i in sizes[3])
    assert set(sizes[4]) == set(sizes[3])
    empty = docs_of([])
    for _, work in corpus_pipeline.STAGES:
        assert work(spark, empty, "").count() == 0


def test_pipeline_decides_rows_by_id_and_text(spark, docs_of):
    """Different texts under one id, and texts without an id, are kept or dropped one by one."""
    text = "the house of the people was in the town and they went with all that they had to be there this evening "
    own = [f"the {w} was in the town and they went with all that they had " * 3 for w in ("tree", "river", "road", "hill")]
    docs = docs_of([(1, text, "en", "a"), (2, text, "en", "a"), (2, own[0], "en", "a"), (3, own[1], "en", "b"), (3, own[2], "en", "b"), (3, own[2] + " ", "en", "b"), (None, own[3], "en", "a"), (None, own[3], "en", "a"), (None, text, "en", "b")], clash=True)
    got = Counter((r.doc_id, r.text.split()[1]) for r in corpus_pipeline.exact_dedup(spark, docs, "").collect())
    assert got == Counter({(1, "house"): 1, (2, "tree"): 1, (3, "river"): 1, (3, "road"): 1, (None, "hill"): 1})
    base = " ".join(f"word{i}" for i in range(90))
    near = docs_of([(4, base, "en", "a"), (5, base + " end", "en", "a"), (5, own[0], "en", "a"), (None, base + " tail", "en", "a"), (None, own[1], "en", "b")], clash=True)
    got = Counter((r.doc_id, r.text.split()[1]) for r in corpus_pipeline.near_dedup(spark, near, "").collect())
    assert got == Counter({(4, "word1"): 1, (5, "tree"): 1, (None, "river"): 1})
    mixed = docs_of([(7, "empty" if i else "", "en", "a") for i in range(2)] + [(8, f"w{i}", "en", "abc"[i % 3]) for i in range(300)], clash=True)
    plain = source_schedule.mix(corpus_pipeline._named(mixed)).where("size > 0").groupBy("source").agg(F.sum("taken")).collect()
    out = Counter(r.source for r in corpus_pipeline.mix_sources(spark, mixed, "").where("text <> ''").collect())
    assert out == Counter({r.source: r[1] for r in plain})


def test_registered_names():
    numbers = sorted(int(name[2:].split("_")[0]) for name in corpus.QUERIES)
    assert numbers == list(range(1, 14)) and set(corpus.ORACLES) <= set(corpus.QUERIES)


def test_texts_are_read_in_small_batches(spark, tmp_path):
    """A batch of the reader holds its texts as one array; 4,096 rows of it burden the heap."""
    path = f"{tmp_path}/documents.parquet"
    spark.range(2000).selectExpr("id AS doc_id", "repeat('long text ', 50) AS text").coalesce(1).write.parquet(path)
    docs = table(spark, str(tmp_path), "documents")
    assert len(docs.collect()) == 2000
    reader = docs._jdf.queryExecution().executedPlan().child()
    assert reader.metrics().apply("numInputBatches").value() == 4


def test_batches_for_python_end_by_bytes(spark):
    """500 long texts are no single batch."""
    texts = prepare(spark).range(0, 400, 1, 1).selectExpr("repeat('long text ', 2000) AS text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows], "size": [batch.nbytes]})

    got = texts.mapInArrow(sizes, "rows long, size long").collect()
    assert sum(r.rows for r in got) == 400 and max(r.size for r in got) < 2 * ARROW_BYTES


def test_stages_begin_with_small_heaps(spark, docs_of):
    """A stage has the heaps collected in full, so that what the stage before left free is no longer taken."""
    beans = [b for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName()]
    docs = docs_of([(1, "the house of the people was in the town", "en", "a")])
    for name, work in corpus_pipeline.STAGES:
        before = sum(b.getCollectionCount() for b in beans)
        work(spark, docs, "").count()
        assert sum(b.getCollectionCount() for b in beans) > before, name


def test_language_scores_hold_one_text_at_a_time(monkeypatch):
    """The trigrams of all texts of a batch take eight times its bytes."""
    made, most, plain = [], [], lf.trigrams

    def counted(text):
        grams = plain(text)
        made[:] = [r for r in made if r() is not None] + [weakref.ref(grams)]
        most.append(len(made))
        return grams

    monkeypatch.setattr(lf, "trigrams", counted)
    model = np.random.default_rng(3).random((lf.BUCKETS, len(lf._CLASSES)))
    texts = ["the house of the people", "", "12", "les gens de la maison"] * 8
    sizes, means = lf._means(pa.array(texts), model)
    assert max(most) <= 2
    want = [plain(t) for t in texts]
    assert sizes == [len(g) for g in want]
    assert np.array_equal(means, [model[g].mean(axis=0) if len(g) else np.zeros(len(lf._CLASSES)) for g in want])
