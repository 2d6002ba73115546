import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from wardlog.llm import cuckoo_index as ci
from wardlog.llm import tensored_minhash as tm
from wardlog.llm.components import components, merged, roots


def brute_exact(rows):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = Counter()
    for i, t, *_ in rows:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        ids = [x for x in groups[key] if x is not None]
        keep = min(ids) if ids else None
        out[(i, keep, len(groups[key]), keep == i, hashlib.sha256(key.encode()).hexdigest())] += 1
    return out


def test_exact_dedup_of_odd_rows(docs_of, odd_rows):
    got = Counter(tuple(r) for r in ci.dedup(docs_of(odd_rows, clash=True)).collect())
    assert got == brute_exact(odd_rows)
    assert ci.dedup(docs_of([])).count() == 0


def test_cuckoo_filter_grows_and_deletes():
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(6000)]
    shard = ci.Shard()
    for n, key in enumerate(keys):
        shard.insert(key, n, 1)
    assert shard.filter.buckets > ci.START_BUCKETS and all(k in shard.filter for k in keys)
    assert all(shard.delete(k) for k in keys[::2]) and not shard.delete(keys[0])
    assert all(shard.find(k) is not None for k in keys[1::2]) and all(shard.find(k) is None for k in keys[::2])
    again = ci.Shard.load(shard.rows(0))
    assert all(again.find(k) == [n, 1] for n, k in list(enumerate(keys))[1::2])


def test_filter_hits_are_verified():
    """Two digests with one fingerprint and bucket are still two contents."""
    one, two = bytes(10) + b"a" * 22, bytes(10) + b"b" * 22
    shard = ci.Shard()
    shard.insert(one, 1, 1)
    assert two in shard.filter and shard.find(two) is None
    shard.insert(two, 2, 1)
    assert shard.delete(one) and shard.find(two) == [2, 1]


def test_index_keeps_state_over_batches(docs_of):
    first = ci.digest_keys(docs_of([(5, "a", "en", "s"), (6, "b", "en", "s"), (7, "b", "en", "s")]))
    later = ci.digest_keys(docs_of([(1, "b", "en", "s"), (2, "c", "en", "s")]))
    index = ci.CuckooIndex(4).insert(first).insert(later)
    live = {r.digest: (r.keep_id, r.n) for r in index.content().collect()}
    digest = {t: hashlib.sha256(t.encode()).digest() for t in "abc"}
    assert {k: live[bytes(v)] for k, v in digest.items()} == {"a": (5, 1), "b": (1, 3), "c": (2, 1)}
    index = index.delete(later.where(F.col("doc_id") == 1))
    asked = ci.digest_keys(docs_of([(0, "a", "en", "s"), (0, "b", "en", "s"), (0, "zzz", "en", "s")]))
    assert [(bytes(r.digest), r.keep_id) for r in index.lookup(asked).collect()] == [(digest["a"], 5)]


def brute_near(rows, threshold):
    sets = []
    for i, t, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        size = min(5, len(words))
        sets.append({tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if words else set())
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            inter = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * inter >= threshold * len(sets[a] | sets[b]):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    out = Counter()
    for n, (i, *_) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if label[m] == label[n] and rows[m][0] is not None]
        component = min(ids) if sets[n] and ids else i
        out[(i, len(sets[n]), component, component == i)] += 1
    return out


def near_rows():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, base = [], [rng.choice(vocabulary) for _ in range(150)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for i in range(150):  # one large group of copies with few and many changes
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6, 12])):
            words[rng.randrange(150)] = rng.choice(vocabulary)
        rows.append((1000 - i, " ".join(words), "en", "s"))
    for i in range(80):  # one passage in texts of their own
        rows.append((2000 + i, " ".join(passage + [rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))]), "en", "s"))
    for i in range(30):  # chains: neighbours are alike, ends are not
        rows.append((3000 + i, " ".join(f"c{k}" for k in range(i * 4, i * 4 + 120)), "en", "s"))
    return rows


def test_near_duplicates_against_all_pairs(docs_of):
    rows = near_rows()
    for threshold in (80, 85):
        got = Counter(tuple(r) for r in tm.near_duplicates(docs_of(rows), threshold).collect())
        assert got == brute_near(rows, threshold)


def test_near_duplicates_of_odd_rows(docs_of, odd_rows):
    got = Counter(tuple(r) for r in tm.near_duplicates(docs_of(odd_rows, clash=True)).collect())
    assert got == brute_near(odd_rows, 80)
    assert tm.near_duplicates(docs_of([])).count() == 0


def test_blocks_of_a_cluster_lose_no_link(docs_of, monkeypatch):
    monkeypatch.setattr(tm, "BLOCK", 16)
    rows = near_rows()[:90]
    got = Counter(tuple(r) for r in tm.near_duplicates(docs_of(rows), 85).collect())
    assert got == brute_near(rows, 85)


def test_components_of_long_chains(spark):
    edges = [(i + 1, i) for i in range(200)] + [(500, 501), (501, 502), (500, 502)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500, 502: 500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_two_levels_of_labels_equal_components(spark):
    """A forest, then links between its trees: roots and merged labels against the components of all edges."""
    rng = random.Random(12)
    forest = [(rng.randrange(b), b) for b in range(1, 120) if rng.random() < 0.8] + [(b - 1, b) for b in range(200, 240)]
    trees = spark.createDataFrame(forest, "a long, b long")
    low = roots(trees)
    root = {r.node: r.label for r in low.collect()}
    joins = {tuple(sorted((root.get(a, a), root.get(b, b)))) for a, b in [(3, 199), (5, 77), (41, 118), (230, 300), (400, 401)]}
    links = spark.createDataFrame([j for j in joins if j[0] != j[1]], "a long, b long")
    got = {r.node: r.label for r in merged(low, components(links)).collect()}
    want = {r.node: r.label for r in components(trees.union(links)).collect()}
    assert all(got.get(node, node) == label for node, label in want.items()) and set(got) <= set(want)
