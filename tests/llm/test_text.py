import math
import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wardlog.llm import histogram_packing as hp
from wardlog.llm import importance_resample as ir
from wardlog.llm import language_fusion as lf
from wardlog.llm import license_index as li
from wardlog.llm import source_schedule as ss
from wardlog.llm import unigram_counts as uc
from wardlog.llm.cutoff import kth_largest


@pytest.fixture(scope="module")
def public():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path


def odd_texts(seed, alphabet, n=3000):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_unigram_counts_equal_the_library(public):
    from tokenizers import Tokenizer, models

    pieces = uc.vocabulary_pieces()
    library, counter = Tokenizer(models.Unigram(pieces, 0, True)), uc.UnigramCounter(pieces)
    for text in odd_texts(1, "abthe ing  \n▁日ç𝄞éxzq<s>") + ["x" * 300, " ", "\n\n a"]:
        want = len(library.encode(uc.MARK + text.replace(" ", uc.MARK)).ids) if text else 0
        assert counter.count(text)[0] == want, text


def test_token_counts_rows(docs_of, odd_rows, public):
    got = Counter((r.doc_id, r.n_tokens) for r in uc.token_counts(docs_of(odd_rows, clash=True)).collect())
    counter = uc.UnigramCounter(uc.vocabulary_pieces())
    assert got == Counter((i, counter.count(t or "")[0]) for i, t, *_ in odd_rows)
    assert uc.token_counts(docs_of([])).count() == 0


def test_word_ids_equal_the_library(public):
    from tokenizers import Tokenizer

    library, words = Tokenizer.from_file(public(hp.VOCABULARY)), hp.WordIds(hp.VOCABULARY)
    texts = odd_texts(2, "aB'sS@#-_~ÀßÐ'tTΣΑς̧́\x1c\x85\xa0\t\n İ12.,!क़") + ["a<|endoftext|>b <|startoftext|>", "İstanbul's don't WE'LL"]
    for text in texts:
        assert np.frombuffer(words.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_rare_words_do_not_displace_known_ones(public):
    words, asked = hp.WordIds(hp.VOCABULARY), []

    class Model:
        def tokenize(self, letters, real=words.model):
            asked.append(letters)
            return real.tokenize(letters)

    words.model = Model()
    for _ in range(3):
        words.encode("Häuser, 'houses'")
    assert "häuser," in words  # one look-up, letters and marks together
    asked.clear()
    words.encode("Häuser, 'houses'")
    assert not asked
    rare = " ".join(f"{a}{b}{c}q" for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyz")
    words.encode(rare)
    assert sum(w in words for w in rare.split()) < 30


def test_blocks_of_texts_equal_the_library(public, monkeypatch):
    from tokenizers import Tokenizer

    library, words = Tokenizer.from_file(public(hp.VOCABULARY)), hp.BlockIds(hp.VOCABULARY)
    texts = odd_texts(3, "aB'sS@#-_~ÀßÐ'tTΣΑς̧́\x00\x1c\x85\xa0\t\n\x0b\x0c İ12.,!क़") + ["a<|endoftext|>b <|startoftext|>", "İstanbul's don't WE'LL", "", " \n"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in words.encode(texts)] == want
    monkeypatch.setattr(hp, "BLOCK_BYTES", 40)  # short blocks, long texts cut at white space
    monkeypatch.setattr(hp, "KEPT_BYTES", 2000)  # kept units make room
    again = hp.BlockIds(hp.VOCABULARY)
    longer = [" ".join(texts[at : at + 9]) for at in range(0, 900, 9)]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in again.encode(texts + longer)][: len(want)] == want
    assert list(again.encode(longer)) == list(words.encode(longer))
    assert again.units.nbytes + again.bounds.nbytes + again.ids.nbytes < 4000
    assert list(words.encode([])) == []


def test_a_block_cuts_each_unit_once(public):
    words, asked = hp.BlockIds(hp.VOCABULARY), []
    cut = words.words.cut
    words.words.cut = lambda token: asked.append(token) or cut(token)
    list(words.encode(["Häuser, 'houses'", "häuser! houses, HÄUSER", "houses"]))
    assert sorted(asked) == ["!", "'", ",", "houses", "häuser"]
    asked.clear()
    list(words.encode(["(houses), häuser"]))
    assert asked == ["(", "),"]


def test_packing_is_a_round_trip(docs_of, odd_rows, public):
    import zlib

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public(hp.VOCABULARY))
    want = Counter()
    for i, text, *_ in odd_rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[(i, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    rows = hp.pack(docs_of(odd_rows, clash=True)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for found in places.values():
        ends = 0
        for offset, length in sorted(found):
            assert offset == ends
            ends += length
        assert ends <= 2048
    assert hp.pack(docs_of([])).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_as_good_as_best_fit_by_document(seed):
    rng = random.Random(seed)
    lengths = [min(100, max(1, int(rng.expovariate(0.04)))) for _ in range(3000)] + [100] * 50 + [51] * 40
    plan = hp.plan_best_fit(Counter(lengths), 100)
    taken, load = Counter(), Counter()
    for length, low, high, _, copies, at in plan:
        assert taken[length] == low and (high - low) % copies == 0
        taken[length] = high
        for rank in range(low, high):
            load[plan[0][3] + 0 + _ + (rank - low) // copies] += length
    assert taken == Counter(lengths) and max(load.values()) <= 100
    spaces = []
    for length in sorted(lengths, reverse=True):
        fitting = [s for s in spaces if s >= length]
        if fitting:
            spaces.remove(min(fitting))
            spaces.append(min(fitting) - length)
        else:
            spaces.append(100 - length)
    assert len(load) <= len(spaces) + 1


def test_mix_meets_its_targets(docs_of):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), "en", rng.choice(["a"] * 12 + ["b", "c", "d", "e", None])) for i in range(1200)]
    got = ss.mix(docs_of(rows, clash=True)).collect()
    sizes = Counter()
    for _, text, _, source in rows:
        sizes[source] += len(text.split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, rest, left = {}, set(names), 1.5 * sum(sizes.values())
    while rest:  # fill up evenly by weight until none is above its limit
        level = left / sum(weights[s] for s in rest)
        full = {s for s in rest if 2 * sizes[s] <= level * weights[s]}
        for s in full or rest:
            target[s] = 2.0 * sizes[s] if full else level * weights[s]
        left -= sum(2 * sizes[s] for s in full)
        rest = rest - full if full else set()
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s in names:
        assert taken[s] == pytest.approx(target[s], rel=0.01)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(t.split())) for i, t, *_ in rows)
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in ss.mix(docs_of(rows)).collect())


def test_mix_meets_targets_of_small_sources(docs_of, monkeypatch):
    """Sources of less than a block, of a few blocks, and without a point of the schedule."""
    monkeypatch.setattr(ss, "LEAST_SLOTS", 8)
    sizes = {"a": 30_000, "b": 5_000, "c": 500, "d": 40, "e": 1, "f": 9_000}
    rows = [(i, " ".join(["w"] * n), "en", s) for i, (s, n) in enumerate((s, k) for s, total in sizes.items() for k in [total // 10] * 10 + [total % 10])]
    got = ss.mix(docs_of(rows)).collect()
    for s, size in sizes.items():
        own = [r for r in got if r.source == s]
        assert own[0].source_size == size and sum(r.taken for r in own) == round(own[0].target)
        assert all(0 <= r.first_pass <= r.size and r.first_pass <= r.taken <= 2 * r.size for r in own)
        assert sum(r.first_pass for r in own) == min(size, round(own[0].target))


def test_mix_does_not_depend_on_layout(docs_of):
    rows = [(i if i % 9 else None, " ".join([f"w{i}"] * (i % 7)), "en", "abc"[i % 3]) for i in range(600)]
    rows += [(5, f"other text {i}", "en", "a") for i in range(5)] + [(7, "the same row", "en", "b")] * 3
    docs = docs_of(rows)
    layouts = [docs, docs.repartition(5, "text"), docs.orderBy(F.desc("text"))]
    one, *others = [Counter((r.doc_id, r.source, r.size, r.taken) for r in ss.mix(d).collect()) for d in layouts]
    assert sum(one.values()) == len(rows) and all(one == x for x in others)


def test_mix_of_odd_rows(docs_of, odd_rows):
    got = ss.mix(docs_of(odd_rows, clash=True)).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.taken <= 2 * r.size for r in got)
    assert ss.mix(docs_of([])).count() == 0
    assert [r.taken for r in ss.mix(docs_of([(1, "", "en", "a"), (2, None, None, None)])).collect()] == [0, 0]


def test_kth_largest(spark):
    rng = random.Random(6)
    values = [rng.choice([rng.getrandbits(60), rng.randrange(20)]) for _ in range(500)]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 2, 250, 400, 500):
        value = sorted(values, reverse=True)[k - 1]
        assert kth_largest(rows, "v", k) == (value, sum(v > value for v in values))


def quality_rows():
    rng = random.Random(7)
    good = [f"good{i}" for i in range(80)]
    rows, labels = [], []
    for i in range(500):
        bad = i % 4 == 0
        words = [rng.choice(good) for _ in range(rng.randrange(20, 80))]
        if bad:
            words[::3] = [rng.choice(["JUNK!!", "spam###", "moron"]) for _ in words[::3]]
        rows.append((i, " ".join(words), "en", "s"))
        if i % 2 == 0 or i % 5 == 0:
            labels.append((i, int(not bad), 0))
    return rows, labels


def test_resampling_keeps_good_held_out_rows(spark, docs_of):
    rows, labels = quality_rows()
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = ir.resample(docs_of(rows, clash=True), labelled, k=375).collect()
    known = {i for i, *_ in labels}
    held_out = [(r.doc_id % 4 != 0, r.kept) for r in got if r.doc_id not in known]
    assert sum(a == b for a, b in held_out) > 0.95 * len(held_out)
    assert sum(r.kept for r in got) == 375


def test_draw_equals_a_plain_gumbel_top_k(spark, docs_of, odd_rows):
    """Every row draws its own noise: repeated rows, rows without an id, and another layout of the same rows."""
    rows = odd_rows + [(None, "no id", "en", "a")] * 40 + [(50, "copy of a row", "en", "a")] * 40 + [(i % 90, f"text {i % 70}", "en", "a") for i in range(300)]
    docs, labelled = docs_of(rows), spark.createDataFrame([(1, 1, 0), (60, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int")

    def chained(same, rank, seed):
        found = xxhash.xxh64_intdigest(struct.pack("<i", seed), seed=42)
        found = xxhash.xxh64_intdigest(same, seed=found)
        return xxhash.xxh64_intdigest(struct.pack("<q", rank), seed=found)

    found, seen = [], Counter()
    for r in ir.weights(docs, ir.fit(docs, labelled)).collect():
        same = bytes(r.same)
        rank = seen[same]
        seen[same] += 1
        uniform = ((chained(same, rank, 3) >> 11) + 0.5) / 2.0**53
        total = math.floor((r.log_weight - math.log(-math.log(uniform))) * 2**ir.UNIT_BITS)
        found.append((total, chained(same, rank, 4) >> 4, r.doc_id, r.n_grams))
    assert max(seen.values()) == 40
    for k in (1, 60, 200):
        want = Counter(f[2:] for f in sorted(found, key=lambda f: f[:2], reverse=True)[:k])
        for layout in (docs, docs.repartition(5, "text")):
            got = ir.resample(layout, labelled, k=k).where("kept").select("doc_id", "n_grams").collect()
            assert Counter(map(tuple, got)) == want
    unnamed = [r.kept for r in ir.resample(docs, labelled, k=200).where("doc_id IS NULL AND n_grams = 3").collect()]
    assert 0 < sum(unnamed) < len(unnamed) == 40


def test_resampling_of_odd_rows(spark, docs_of, odd_rows):
    labelled = spark.createDataFrame([(1, 1, 0), (8, 0, 0), (99, 1, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for labels in (labelled, none):
        got = ir.resample(docs_of(odd_rows, clash=True), labels, k=5).collect()
        assert len(got) == len(odd_rows) and sum(r.kept for r in got) == 5
    assert ir.resample(docs_of([]), labelled).count() == 0


def test_ratio_against_a_plain_count(spark, docs_of):
    rows, labels = quality_rows()
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    raw, target, good = Counter(), Counter(), {i for i, q, t in labels if q and not t}
    for i, text, *_ in rows:
        grams = Counter(ir.gram_buckets(text).tolist())
        raw += grams
        target += grams if i in good else Counter()
    share = sum(target.values()) / sum(raw.values())
    plain = {b: np.log(target[b] + ir.SMOOTHING) - np.log(raw[b] * share + ir.SMOOTHING) for b in raw}
    mean = sum(target[b] * plain[b] for b in raw) / sum(target.values())
    ratio = ir.fit(docs_of(rows), labelled)
    assert all(ratio[b] == pytest.approx(v - mean) for b, v in plain.items())


def test_licence_base_against_plain_search(docs_of, odd_rows):
    rng = random.Random(8)
    words = ["GNU", "general", "public", "license", "Apache", "cc", "by", "MIT", "x", "é9", "-", "nc", "4.0"]
    rows = odd_rows + [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(60))), "en", "s") for i in range(300)]
    rows += [(900, "Licensed under the Apache License, Version 2.0.", "en", "s"), (901, "Released under the MIT license.", "en", "s")]
    rows += [(902, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated files", "en", "s")]
    got = {}
    for r in li.scan(docs_of(rows, clash=True)).collect():
        got.setdefault(r.doc_id, []).append(r)
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    for i, text, *_ in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        starts = [(at, label) for phrase, label in li.PHRASES for at in range(len(found)) if found[at : at + len(phrase.split())] == phrase.split()]
        places = [at for at, _ in starts]
        want = (len(found), len(starts), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in starts})))
        assert want in [(r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got[i]]
    assert got[900][0].labels == "apache,apache-2.0" and got[901][0].labels == "mit,mit-notice"
    assert got[902][0].labels == "mit-text" and 0.6 <= got[902][0].score < 1
    assert li.scan(docs_of([])).count() == 0


def test_licence_text_opening_inside_a_passage(docs_of):
    """A text that opens with the later part of a passage has the labels that the same words have behind others."""
    texts = {"GNU Lesser General Public License": "lgpl", "CC BY-SA 4.0": "cc-by,cc-by-sa", "GNU General Public License version 3": "gpl,gpl-3.0"}
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    rows += [(10 + i, "one two three four five six seven " + t, "en", "s") for i, t in enumerate(texts)]
    rows += [(20 + i, "this work is licensed under the terms", "en", "s") for i in range(30)]
    got = {r.doc_id: (r.labels, r.score) for r in li.scan(docs_of(rows)).collect()}
    for i, label in enumerate(texts.values()):
        assert got[i][0] == label and got[i] == got[10 + i]


SAMPLES = {
    "en": "the house of the people was in the town and they went with all that they had to be there this evening",
    "de": "das haus der leute war in der stadt und sie gingen mit allem was sie hatten um an diesem abend dort zu sein",
    "fr": "la maison des gens était dans la ville et ils sont venus avec tout ce qu'ils avaient pour être là ce soir",
    "es": "la casa de la gente estaba en la ciudad y ellos fueron con todo lo que tenían para estar allí esta noche",
}


def language_rows():
    rng = random.Random(9)
    rows = []
    for i in range(400):
        language = list(SAMPLES)[i % 4]
        words = SAMPLES[language].split()
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(3, 30)))
        declared = rng.choice(list(SAMPLES)) if rng.random() < 0.1 else language
        rows.append((i, text, declared + rng.choice(["", "-XX"]), f"host{i % 7}.{language}x"))
    return rows + [(1000, "ไทยภาษาไทยภาษา" * 5, "th", "host1.enx"), (1001, "123 456 !!!", "en", None), (1002, "", "en", "host1.enx")]


def test_language_beats_wrong_declarations(docs_of):
    got = {r.doc_id: r for r in lf.identify(docs_of(language_rows(), clash=True)).collect()}
    assert sum(got[i].language == list(SAMPLES)[i % 4] for i in range(400)) >= 396
    assert not any(got[i].kept for i in (1000, 1001, 1002)) and sum(got[i].kept for i in range(400)) >= 398


def test_language_of_odd_rows(docs_of, odd_rows):
    got = lf.identify(docs_of(odd_rows, clash=True)).collect()
    assert len(got) == len(odd_rows)
    assert not any(r.kept for r in got if r.doc_id in (3, 4, 5, 8))
    assert all(r.kept for r in lf.identify(docs_of([(1, "any text", None, None)])).collect())
    assert lf.identify(docs_of([])).count() == 0


def test_language_posterior_by_hand(docs_of):
    """The posterior equals the product of its parts, computed row by row."""
    rows = language_rows()
    logs = np.zeros((lf.BUCKETS, 5))
    tag = lambda g: g.split("-")[0] if g.split("-")[0] in lf.LANGUAGES else "other"
    for text, declared in ((t, tag(g)) for _, t, g, _ in rows if tag(g) != "other"):
        np.add.at(logs[:, lf.LANGUAGES.index(declared)], lf.trigrams(text), 1)
    logs = np.log((logs + lf.SMOOTHING) / (logs.sum(axis=0) + lf.SMOOTHING * lf.BUCKETS))
    logs[:, 4] = -np.log(lf.BUCKETS)
    classes = [*lf.LANGUAGES, lf.UNKNOWN]
    means = {i: logs[lf.trigrams(t)].mean(axis=0) for i, t, *_ in rows if len(lf.trigrams(t))}
    best = {i: classes[int(np.argmax(m))] for i, m in means.items()}
    info = {i: (tag(g), h, (h or "").rpartition(".")[2] if "." in (h or "") else "") for i, _, g, h in rows}
    count = lambda f: Counter(f(i) for i in best)
    start = {c: 0.01 if c == "und" else 0.99 / 4 for c in classes}
    n, by_class = len(best), count(lambda i: best[i])
    of_all = {c: (by_class[c] + 10 * start[c]) / (n + 10) for c in classes}
    host, host_class = count(lambda i: info[i][1]), count(lambda i: (info[i][1], best[i]))
    suffix, suffix_class = count(lambda i: info[i][2]), count(lambda i: (info[i][2], best[i]))
    given, declared = count(lambda i: (info[i][0], best[i])), count(lambda i: info[i][0])
    for r in lf.identify(docs_of(rows)).collect():
        if r.doc_id not in means:
            continue
        d, h, s = info[r.doc_id]
        joint = []
        for k, c in enumerate(classes):
            of_suffix = (suffix_class[s, c] + 10 * of_all[c]) / (suffix[s] + 10) if s else of_all[c]
            prior = (host_class[h, c] + 10 * of_suffix) / (host[h] + 10) if h in host else of_all[c]
            told = (given[d, c] + 10 * declared[d] / n) / (by_class[c] + 10)
            joint.append(min(60, r.n_grams) * means[r.doc_id][k] + np.log(told) + np.log(prior))
        parts = np.exp(np.array(joint) - max(joint))
        assert r.language == classes[int(np.argmax(joint))] and r.posterior == pytest.approx(1 / parts.sum(), rel=1e-6)
