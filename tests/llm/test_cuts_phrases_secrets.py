import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardlog.llm import learned_cuts as lc
from wardlog.llm import ownership_scan as os_
from wardlog.llm import phrase_fingerprints as pf


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- learned cuts


@pytest.mark.parametrize("error", [1, 16, 512, 1 << 20])
def test_rank_index_is_exact(error):
    rng = np.random.default_rng(error)
    for steps in ([], [5], rng.integers(1, 4, 3000), rng.integers(1, 10**6, 500), np.concatenate([np.ones(2000, int), [10**7], np.full(900, 80)])):
        offsets = np.concatenate([[0], np.cumsum(np.array(steps, np.int64))]).astype(np.int64)
        index = lc.RankIndex.fit(offsets, error)
        every = np.arange(len(offsets))
        assert (index.offset(every) == offsets).all()
        assert np.abs(offsets - index.predict(every)).max() <= error + 1


def test_even_lines_are_one_segment():
    assert len(lc.RankIndex.fit(np.arange(0, 800_000, 80)).ranks) == 1


def plain_cut(doc_id, text):
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n, digits = len(lines), hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digits[i : i + 8], 16) for i in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < 50:
        return doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


MORE = ["\n", "\n\n\n", "a\n", "a\nb", "é𝄞\n日本\r\nç", "<P>\nx", "a <S", "<<P\n>", "x" * 3_000_000, ("zeile ü\n" * 300_000), " \x0b\x0c\n\x85"]


def test_fill_in_middle_rows(docs_of, odd_rows):
    rows = odd_rows + [(100 + i, t, "en", "a") for i, t in enumerate(MORE)] + [(-5, "a\nb\nc", None, None)]
    cut = lc.fill_in_middle(docs_of(rows, clash=True))
    got = cut.withColumn("back", lc.restore(F.col("output"), F.col("form"))).collect()
    want = Counter(plain_cut(i, t or "") for i, t, *_ in rows)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got) == want
    texts = defaultdict(set)
    for i, t, *_ in rows:
        texts[i].add(t or "")
    assert all(r.back in texts[r.doc_id] for r in got)
    assert lc.fill_in_middle(docs_of([])).count() == 0


def test_shares_and_index_rows(docs_of):
    rows = [(i, f"line {i}\n" * (i % 40 + 1), "en", "a") for i in range(2000)]
    forms = Counter(r.form for r in lc.fill_in_middle(docs_of(rows), percent=40, spm=25).collect())
    assert abs(forms["plain"] - 1200) < 100 and abs(forms["spm"] - 200) < 60
    for r in lc.boundary_index(docs_of(rows[:50])).collect():
        index = lc.RankIndex(np.array(r.ranks), np.array(r.offsets), np.array(r.slopes), np.frombuffer(r.residuals, "<i2"))
        assert (index.offset(np.arange(r.n + 1)) == lc.boundaries(dict((i, t) for i, t, *_ in rows)[r.doc_id])).all()


def test_marks_must_be_told_apart():
    for marks in (("<P>", "<P>", ">S"), ("ab", "bc", "x"), ("", "a", "b"), ("aa", "b", "c")):
        with pytest.raises(ValueError):
            lc.checked_marks(marks)


# -- phrases


def plain_phrases(rows, longest, least, top, covered):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for s in range(1, longest + 1):
                f[lang or "und"].update(tuple(w[i : i + s]) for i in range(len(w) - s + 1))
    out = []
    for lang, counts in f.items():
        found = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        gone = set()
        for g, a in found.items():
            for s in range(2, len(g)):
                gone |= {g[i : i + s] for i in range(len(g) - s + 1) if 100 * a >= covered * found[g[i : i + s]]}
        scored = []
        for g, a in found.items():
            if g not in gone:
                score, _, l, r = min((1000000 * a * a // (counts[g[:k]] * counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))
                scored.append((-score, -a, " ".join(g).encode(), l, r))
        for rank, (score, a, g, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, g.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def phrase_rows(seed, n=120):
    rng = random.Random(seed)
    words = ["the", "The", "of", "ab", "abab", "ça", "日本", "x y", "\x00", "new", "york", "city", "A"]
    gaps = [" ", " ", " ", "  ", "\t", " \t ", ", ", ".", "\n", "\r", "\x0b"]
    return [("".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randint(0, 90))), rng.choice(["en", "de", None])) for _ in range(n)]


@pytest.mark.parametrize("longest,chunk,bits", [(3, 1 << 15, 64), (3, 200, 64), (3, 3, 64), (2, 64, 64), (4, 500, 64), (3, 1 << 15, 3), (3, 300, 5)])
def test_collocations_equal_a_plain_count(docs_of, longest, chunk, bits):
    """Small chunks cut pieces between words; few bits make most phrases collide."""
    rows = phrase_rows(longest * chunk) + [(None, None), ("", "en"), (" ., \t", "fr")]
    got = pf.collocations(docs_of([(i, t, g, "a") for i, (t, g) in enumerate(rows)], clash=True), longest, 4, 40, 50, chunk, bits)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == plain_phrases(rows, longest, 4, 40, 50)


def test_collocations_of_odd_rows(docs_of, odd_rows):
    giant = [(None, "new york " * 100_000, "en", "a"), (9, "x" * 5_000_000, "en", "a"), (9, ("y" * 700 + " ") * 20_000, None, "a")]
    rows = odd_rows + giant
    got = sorted(map(tuple, pf.collocations(docs_of(rows), chunk=1 << 16).collect()))
    assert got == plain_phrases([(t, g) for _, t, g, _ in rows], 3, 10, 2000, 50)
    assert pf.collocations(docs_of([])).count() == 0


def test_runs_are_a_round_trip():
    rng = np.random.default_rng(5)
    for n in (1, 2, 1000):
        fields = {"fp": np.sort(rng.integers(0, 2**64, n, np.uint64)), "pointer": rng.integers(0, 2**62, n), "n": rng.integers(1, 2**31, n), "check": rng.integers(0, 2**32, n)}
        back = pf.unpacked(pf.packed(fields))
        assert all((back[name] == fields[name].astype(kind)).all() for name, kind in pf._FIELDS)


def test_parts_keep_every_phrase_once():
    rng = random.Random(3)
    for _ in range(300):
        words = "".join(rng.choice(["a", "bb", " ", "  ", "\n", "ccccccc"]) for _ in range(rng.randint(0, 60))).encode()
        for size in (1, 2, 5, 17):
            got = Counter()
            for skip, part in pf.parts_of(words, 3, size):
                chunk = pf.Words([part], [skip])
                for s in (1, 2, 3):
                    places = np.flatnonzero(chunk.within(s)).tolist()
                    got.update(pf.phrases_at(part, places, [s] * len(places)))
            want = Counter()
            for piece in words.split(b"\n"):
                w = piece.split()
                want.update(b" ".join(w[i : i + s]).decode() for s in (1, 2, 3) for i in range(len(w) - s + 1))
            assert got == want, (words, size)


# -- secrets

PATTERNS = [
    ("assign", re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 1, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def plain_base(text):
    found = []
    for kind, (name, pattern, group, least) in enumerate(PATTERNS):
        found += [(m.start(), kind, name, m.end()) for m in pattern.finditer(text) if len(m.group(group)) >= least]
    return [f"{name}:{start}:{end}" for start, _, name, end in sorted(found)]


def test_base_spans_equal_the_patterns(docs_of, odd_rows):
    rng = random.Random(9)
    bits = ["password", "PassWd", "toKEN", "api_key", "APIKEY", "secret", "=", ":", " = ", '"', "'", "abc", "AKIA", "AKIA" + "Z9" * 9, "0123456789abcdef" * 2, "deadbeef" * 3, " ", "é", "𝄞", "\n", "x1/+y", "ſecret", "toKen=abcdef", "token" + " " * 50]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40))), "en", "a") for i in range(800)]
    rows += odd_rows + [(5000, "token=abc" + "d" * 400_000, "en", None), (5001, "password: 1a2b3c4d, " * 30_000, "en", "z"), (5002, "a" * 2_000_000, None, "z")]
    got = os_.report(os_.scan(docs_of(rows, clash=True))).collect()
    want = Counter()
    for i, t, *_ in rows:
        spans = plain_base(t or "")
        number = Counter(s.split(":")[0] for s in spans)
        want[(i, number["assign"], number["access"], number["hex"], sha(",".join(spans)))] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    assert os_.report(os_.scan(docs_of([]))).count() == 0


def test_ownership_tells_examples_from_live_values(docs_of):
    copied, live, two = "ghp_" + "aB3dE5gH7jK9mN1pQ3sT5vW7" , "ghp_" + "zY8xW6vU4tS2rQ0pO8nM6lK4", "xoxb-1234567890-abcdefghij"
    rows = [(i, f"use {copied} here", "en", f"owner{i % 5}") for i in range(60)]
    rows += [(100, f"my {live}", "en", "me"), (101, f"again {live} and ghp_{'w' * 30}", "en", "me"), (102, two, "en", "a"), (103, two, "en", "b"), (104, live, "en", "me"), (104, live, "en", "me")]
    rows += [(200 + i, "password=changeme99", "en", f"owner{i}") for i in range(4)] + [(300, "password=hT5kQ9zX2w", "en", None)]
    got = {r.doc_id: r for r in os_.report(os_.scan(docs_of(rows))).collect()}
    assert all(got[i].spans == "" and got[i].n_live == 0 for i in range(60))
    assert got[100].spans == f"forge:3:{3 + len(live)}" and got[101].n_live == 1 and got[101].spans == f"forge:6:{6 + len(live)}"
    assert got[102].spans == got[103].spans == "" and got[104].spans == f"forge:0:{len(live)}"
    assert all(got[200 + i].n_copied == 1 and got[200 + i].spans == "assign:0:19" for i in range(4))
    assert got[300].n_live == 1
    spans = os_.scan(docs_of(rows)).where("doc_id = 104").select(F.explode("spans").alias("s")).select("s.*").first()
    assert (spans.owners, spans.repositories, spans.verdict) == (1, 3, "live")


def test_running_sums(spark):
    for n in (1, 2, 511, 512, 513, 5000):
        row = spark.range(1).select(os_.running_sums(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))).alias("s")).first()
        assert row.s == [i * (i + 1) // 2 for i in range(n)]
