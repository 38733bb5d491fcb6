"""Periodic runs, phrase collocations and nearest neighbours against plain versions, with edge cases."""

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from driftlog.llm import collision_search, collocations, oracle, perfect_hash, periodic_runs, queries

DIR = "/root/testdata/sf0.001"


def plain_runs(word, least, times):
    """Every stretch that keeps a period as long as it can, of each period on its own."""
    out = {}
    for q in range(1, len(word) // times + 1):
        at = 0
        while at + q < len(word):
            end = at
            while end + q < len(word) and word[end] == word[end + q]:
                end += 1
            if end > at and end + q - at >= max(least, times * q):
                out.setdefault((at, end + q), q)
            at = max(end, at + 1)
    return out


def test_runs_equal_a_plain_search():
    draw = random.Random(11)
    for _ in range(1500):
        least, times, letters = *draw.choice([(2, 2), (24, 3), (6, 3), (8, 2), (12, 3)]), draw.choice([1, 2, 2, 3, 5])
        word = [draw.randrange(letters) for _ in range(draw.randint(0, 90))]
        for _ in range(draw.randint(0, 3)):
            if word:
                at, q = draw.randrange(len(word)), draw.randint(1, 12)
                word[at:at] = (word[at : at + q] * draw.randint(1, 9))[: draw.randint(1, 60)]
        word += word[: draw.randint(0, 70)]
        want = plain_runs(word, least, times)
        assert periodic_runs.runs(word, least, times) == want
        assert periodic_runs.word_runs([b"w%d" % c for c in word], least, times) == sorted(((a, b - a, q) for (a, b), q in want.items()), key=lambda r: (r[0], r[2]))


def test_factors_occur_earlier_and_are_longest():
    draw = random.Random(5)
    for _ in range(200):
        word = [draw.randrange(2) for _ in range(draw.randint(1, 40))]
        at = 0
        for begin, end, source in periodic_runs.factors(word):
            assert begin == at and (source < 0 or (source < begin and word[source : source + end - begin] == word[begin:end]))
            longer = word[begin : end + (source >= 0)]
            assert end == len(word) or not any(word[i : i + len(longer)] == longer for i in range(begin))
            at = end
        assert at == len(word)


def told(words):
    found = sorted((a, b - a, q) for (a, b), q in plain_runs(words, 24, 3).items())
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (len(found), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], digest("".join(f"{a},{n},{q}\n" for a, n, q in found).encode()), digest(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_the_run_query_equals_a_plain_version(spark):
    want, several = {}, 0
    for r in spark.read.parquet(f"{DIR}/documents.parquet").collect():
        words = re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode())
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a, start = g % n, words
            p = 1 + (n - a) // (3 + g % 8)
            words = [start[i] if i < a else start[a + (i - a) % p] for i in range(n)]
        want[r.doc_id] = told(words)
        several += want[r.doc_id][0] > 0
    assert {r[0]: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, DIR).collect()} == want and several > 3


def test_run_edge_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, " \t\n", "x"), (4, "a " * 23, "x"), (5, "a " * 24, "x"), (5, "a " * 24, "x"), (None, "b c " * 12 + "end", "x"), (6, "ü \x00 " * 50_000, "x"), (7, "x\x1cy " * 30, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_runs string")
    got = sorted(((r.doc_id or 0), tuple(r)[1:]) for r in periodic_runs.periodic_runs(df).collect())
    assert got == sorted(((i or 0), told((t or "").encode().split()) if i != 6 else got[-2][1]) for i, t, _ in rows)
    assert got[-2][1][:5] == (1, 0, 100_000, 2, 50_000_000)
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0


def test_perfect_hash_is_minimal_and_knows_its_keys(spark):
    draw = np.random.default_rng(2)
    keys = np.unique(np.concatenate([draw.integers(-(2**63), 2**63 - 1, 3000), np.arange(-50, 50)]))
    one = perfect_hash.PerfectHash(keys)
    assert sorted(one.find(keys).tolist()) == list(range(len(keys)))
    assert (one.find(np.setdiff1d(draw.integers(-(2**63), 2**63 - 1, 3000), keys)) == -1).all() and perfect_hash.PerfectHash(keys[:0]).find(keys[:9]).tolist() == [-1] * 9
    table = perfect_hash.Slots(spark.createDataFrame([(int(k),) for k in keys], "key long"), block_keys=500)
    slots = table.find(keys)
    assert table.blocks > 3 and sorted(slots.tolist()) == list(range(len(keys))) and (table.keys(slots) == keys).all() and (table.find(keys + (1 << 40)) == -1).all()
    with pytest.raises(ValueError):
        perfect_hash.PerfectHash(np.array([3, 3]))


def plain_phrases(rows, least=30):
    """All counts in one dictionary, all rules one after the other."""
    f, total = collections.Counter(), collections.Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            total[lang] += len(w)
            f.update((lang, w[i : i + m]) for m in (1, 2, 3, 4) for i in range(len(w) - m + 1))
    often = {k for k, n in f.items() if n >= least and len(k[1]) > 1}
    inside = collections.Counter()
    for lang, w in often:
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w):
                    inside[lang, w[i:j]] = max(inside[lang, w[i:j]], f[lang, w])
    out = []
    for lang, w in often:
        a = f[lang, w]
        if 100 * inside[lang, w] >= 80 * a:
            continue
        s, _, l, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, l, r, total[lang], s))
    out.sort(key=lambda x: (x[0], -x[6], -x[2], x[1].encode()))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_phrases_equal_a_plain_version(spark, monkeypatch, small):
    if small:  # every bound is met many times
        for name, value in dict(CHUNK=16, LIVE=2, FAN=2, WORDS_HELD=9, KEYS_HELD=20, IDS_HELD=30, PART=40).items():
            monkeypatch.setattr(collocations, name, value)
        monkeypatch.setattr(perfect_hash, "BLOCK_KEYS", 10)
    draw = random.Random(4)
    words = ["New", "york", "CITY", "of", "the", "Été", "é", "x\x0by", "a b", "\x00"]
    rows = []
    for i in range(400):
        text = draw.choice([" ", "\t", "  "]).join(draw.choice(["New York City hall", "the end of the day", draw.choice(words), draw.choice(words)]) + draw.choice(["", "", ".", ", ", "\n", "!?"]) for _ in range(draw.randint(0, 12)))
        rows.append((i if i % 9 else None, text, draw.choice(["en", "de", None])))
    rows += [(1, None, "en"), (2, "", "fr"), (3, "go go " * 200, "fr"), (3, "go go " * 200, "fr"), (4, ". , " * 50, "es")]
    df = spark.createDataFrame([(*r, "kept", 1) for r in rows], "doc_id long, text string, lang string, phrase string, n int").repartition(5)
    got = [tuple(r) for r in collocations.collocations(df).orderBy("lang", "rank").collect()]
    want = plain_phrases([(t, l) for _, t, l in rows])
    assert [(g[0], *g[2:]) for g in got] == want and len(want) > 8 and {g[0] for g in got} == {"en", "de", "fr", "und"}
    assert [g[1] for g in got] == [1 + sum(w[0] == want[i][0] for w in want[:i]) for i in range(len(want))]
    if not small:
        first = collocations.collocations(df, top=3).collect()
        assert sorted((r.lang, r.rank, r.phrase) for r in first) == sorted((g[0], g[1], g[2]) for g in got if g[1] <= 3)
        assert collocations.collocations(df.limit(0)).count() == 0 and collocations.collocations(df.limit(3)).count() == 0


def test_the_phrase_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DIR}/documents.parquet'")
    cur = con.execute(oracle.OP12_SQL)
    columns = [c[0] for c in cur.description]
    got = queries.op12_collocations(spark, DIR)
    assert sorted(columns) == sorted(got.columns)
    want = sorted(map(repr, cur.fetchall()))
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == want and want


def plain_neighbours(rows, k=5):
    """All cosines of a query, in double precision."""
    sound = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for n, (i, v) in enumerate(sound):
        if i is not None and i % 50 == 0:
            near = sorted((-float((v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum()))), j if j is not None else 1 << 63) for m, (j, w) in enumerate(sound) if m != n and len(w) == len(v))
            out.setdefault(i, []).append(near[:k])
    return out


@pytest.mark.parametrize("block", [1 << 14, 60])
def test_neighbours_are_the_nearest(spark, monkeypatch, block):
    monkeypatch.setattr(collision_search, "BLOCK", block)
    monkeypatch.setattr(collision_search, "QUERIES", 4)
    source = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{source}/embeddings.parquet").collect()]
    want, got = plain_neighbours(rows), collections.defaultdict(list)
    for r in queries.op13_collision_search(spark, source).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert got.keys() == want.keys()
    assert all([x[0] for x in v] == [1, 2, 3, 4, 5] and all(abs(dict(plain_all(rows, q))[i] - s) < 1e-12 for _, i, s in v) for q, v in got.items())
    found = sum(len({i for _, i, _ in got[q]} & {i for _, i in want[q][0]}) for q in want)
    assert found >= 0.95 * 5 * len(want)


def plain_all(rows, q):
    own = np.array(dict(rows)[q], float)
    m = np.array([v for _, v in rows], float)
    return zip([i for i, _ in rows], (m @ own / (np.sqrt((m * m).sum(1)) * np.sqrt(own @ own))).tolist())


@pytest.mark.parametrize("block", [1 << 14, 7])
def test_neighbour_edge_cases(spark, monkeypatch, block):
    monkeypatch.setattr(collision_search, "BLOCK", block)
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (50, None), (100, [0.0, 0.0]), (150, [nan, 1.0]), (200, [inf, 1.0]), (250, [None, 1.0]), (300, [])]
    rows += [(7, [2.0, 0.0]), (5, [3.0, 0.0]), (3, [0.5, 0.0]), (9, [1.0, 1e-9]), (11, [0.0, -1.0]), (13, [-1.0, 0.0]), (None, [4.0, 0.0]), (350, [1e200, 1e200]), (400, [1.0, 2.0, 3.0]), (401, [2.0, 4.0, 6.0]), (450, [5.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, rank int, block string")
    got = collections.defaultdict(list)
    for r in collision_search.nearest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, round(r.score, 12)))
    assert got.keys() == {0, 350, 400}  # 450 has no other vector of its length
    assert sorted(got[0]) == sorted(2 * [(1, 0, 1.0), (2, 3, 1.0), (3, 5, 1.0), (4, 7, 1.0), (5, 9, 1.0)])
    assert got[400] == [(1, 401, 1.0)] and [i for _, i, _ in got[350]][0] == 9 and len(got[350]) == 5
    assert collision_search.nearest(df.limit(0)).count() == 0
