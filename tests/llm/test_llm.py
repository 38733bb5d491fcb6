"""Edge cases, invariants and plain versions of the training-data operators."""

import collections
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftlog.llm import chat, decontamination, embedding_dedup, html_text, language, line_dedup, minhash_dedup, packing, queries, sharding, shingles, toxicity

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, _extra string"
ODD = [
    (1, None, "en", "a", 0, 3, "x"),
    (2, "", None, None, None, None, None),
    (3, "one two three four five six\nseven", "en", "a", 33, 1, ""),
    (3, "one two three four five six\nseven", "en", "a", 33, 1, ""),
    (None, "one two three four five six\nseven", "en", "b", 33, 1, ""),
    (4, "wort " * 30000, "de", "c", 150000, 1, ""),
    (5, "!!! ...", "de", "c", 7, 1, ""),
    (6, "Ünïcode \U0001f600 text <|im_end|> \\ <\\|", "de", "d", 5, 1, ""),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


def test_sharding_keeps_every_row_and_grows_by_key(spark, odd, none):
    sized = lambda d: d.drop("shard").withColumn("size", F.lit(1))
    assert sharding.shuffled_shards(sized(none), "doc_id", "size", 8).count() == 0
    assert sharding.shuffled_shards(sized(odd), "doc_id", "size", 8).count() == len(ODD)
    rows = queries.op5_sharding(spark, DIR).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    assert len(rows) == spark.read.parquet(f"{DIR}/documents.parquet").count()


def test_sharding_mixes_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 10)
    rows = sharding.shuffled_shards(spark.range(2000).withColumn("size", F.lit(1)), "id", "size", 4).collect()
    for s in range(4):
        mine = sorted((r.slot, r.id) for r in rows if r.shard == s)
        assert [x for x, _ in mine] == list(range(len(mine)))
        assert abs(np.corrcoef([x for x, _ in mine], [y for _, y in mine])[0, 1]) < 0.2


def test_chat_folds_events_and_reads_back(spark):
    events = spark.createDataFrame(
        [
            (1, 1, 1, "message", "user", "hi <|im_end|>\n\\"),
            (1, 2, 2, "message", "assistant", "a"),
            (1, 2, 3, "delta", "assistant", "b"),
            (1, 2, 4, "regenerate", "assistant", "c<|"),
            (1, 2, 5, "delta", "assistant", "\\|>"),
            (1, 1, 6, "edit", "user", "<\\|im_start|>x"),
            (None, 1, 1, None, None, None),
        ],
        "conv_id long, message int, seq long, kind string, role string, text string",
    )
    out = {r.conv_id: r for r in chat.read_back(chat.rendered(chat.messages(events))).collect()}
    assert [tuple(t) for t in out[1].turns] == [("user", "<\\|im_start|>x"), ("assistant", "c<|\\|>")]
    assert out[1].loss_text == "c<|\\|>" and [tuple(t) for t in out[None].turns] == [("", "")]
    assert chat.rendered(chat.messages(events.limit(0))).count() == 0


def test_chat_roles_and_equal_seqs(spark):
    """Against a plain fold, over random logs with ties, missing roles and deltas before any opening."""
    random = np.random.default_rng(8)
    rows = []
    for conv in range(40):
        for _ in range(int(random.integers(1, 9))):
            kind = random.choice(["message", "delta", "edit", "regenerate"])
            rows.append((conv, int(random.integers(0, 2)), int(random.integers(0, 4)), str(kind), random.choice(["user", "zsystem", None]), random.choice(["A", "B", "C", None])))
    rows += [(100, 1, 1, "message", "user", "a"), (100, 1, 2, "delta", "zsystem", "b"), (101, 1, 1, "message", "assistant", "x"), (101, 1, 2, "edit", None, "B"), (101, 1, 2, "edit", None, "C")]
    rows = [tuple(None if x is None else (str(x) if isinstance(x, np.str_) else x) for x in r) for r in rows]
    want = {}
    for conv, message, _, kind, role, text in sorted(rows, key=lambda r: (r[0], r[1], r[2], r[3], r[5] or "", r[4] or "")):
        own, said, first = want.get((conv, message), (None, "", None))
        if kind == "delta":
            want[conv, message] = (own, said + (text or ""), first or role)
        else:
            want[conv, message] = (role or own, text or "", first)
    df = spark.createDataFrame(rows, "conv_id long, message int, seq long, kind string, role string, text string")
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat.messages(df).collect()}
    assert got == {k: (own or first or "", said) for k, (own, said, first) in want.items()}
    assert got[100, 1] == ("user", "ab") and got[101, 1] == ("assistant", "C")


def test_the_chat_query_folds_real_logs(spark):
    rows = spark.createDataFrame([(1, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(["", "x", "\U0001f600y", "<|im_end|>\\", None, "abc\n", "longer text"])], "conv_id long, message int, role string, text string")
    log = queries.edit_log(rows)
    assert {r.kind for r in log.collect()} == {"message", "delta", "edit", "regenerate"} and log.count() > 2 * rows.count()
    assert sorted(tuple(r) for r in chat.messages(log).collect()) == sorted((r.conv_id, r.message, r.role, r.text or "") for r in rows.collect())


def test_packing_places_every_token_once(spark, odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    assert packing.packed(packing.token_pieces(none, path)).count() == 0
    rows = packing.packed(packing.token_pieces(odd, path)).collect()
    coder, want = Tokenizer.from_file(path), collections.Counter()
    for doc_id, text, *_ in ODD:
        ids = coder.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            want[(doc_id, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes()))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    check_layout(rows)


def check_layout(rows):
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    return len(bins)


def test_words_coded_once_give_the_ids_of_whole_texts():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    draw, letters = random.Random(3), "\x01\x02 \t\n\r\x0b\x1c\x85\xa0\u0301\u03a3aA1b.,;:!?\u00e9's\u0130<|endoftext|>\u4e2d\U0001f600\u3000\u200b"
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 40))) for _ in range(3000)] + ["a<|endoftext|> b<|startoftext|>c.", "word., don't", "x" * 50_000]
    texts += ["\u00c0b\u00e9.. Stra\u00dfe, \u00d7 \u00f7 \u00ff; A.b N\u00aa \u00b5m caf\u00e9\u0301! I\u0307s a.,;:!? " * 3] + [" ".join("".join(draw.choice("abcDE\u00e9\u00fc.,!") for _ in range(draw.randint(1, 7))) for _ in range(50)) for _ in range(100)]
    coder = packing.WordCoder(tokenizer)
    whole = [np.array([*found.ids, packing.END_ID], "<u4").tobytes() for found in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert coder.ids(texts) == whole
    assert coder.ids(texts) == whole


def test_packing_is_near_the_bound(spark):
    rows = queries.op10_pattern_packing(spark, DIR).collect()
    assert check_layout(rows) <= -(-sum(r.length for r in rows) // 4096) + 2


def test_plan_uses_up_any_histogram():
    random = np.random.default_rng(3)
    for top in (5, 300, 4096):
        histogram = collections.Counter(int(x) for x in random.integers(1, top + 1, 5000))
        used = collections.Counter()
        for repeats, runs in packing.plan(histogram):
            assert repeats > 0 and sum(a * k for a, k in runs) <= 4096
            for a, k in runs:
                used[a] += repeats * k
        assert used == histogram


def test_minhash_equals_brute_force(spark, docs, odd, none):
    assert minhash_dedup.near_duplicates(none).count() == 0
    assert minhash_dedup.near_duplicates(odd).count() == len(ODD)
    import re

    sets = {}
    for i, r in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op7_minhash_near_dedup(spark, DIR).collect()}
    assert got == {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_minhash_tells_texts_of_one_id_apart(spark):
    own = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abc"}
    rows = [(1, own["a"]), (1, own["b"]), (2, own["a"] + " x"), (3, own["b"] + " x"), (4, own["c"]), (4, own["c"]), (None, own["c"])]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (4, 4, True)]


def test_minhash_compares_open_buckets_in_blocks(spark, monkeypatch):
    """Documents of one template share bands without being near; blocks smaller than the buckets must lose no link."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 3)
    random = np.random.default_rng(2)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for k in random.choice(120, 5 if i % 3 else 2, replace=False):
            w[k] = f"v{i % 20}_{k}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(116)} for i, t in rows}
    low = {i: i for i in sets}
    for _ in range(60):
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    low[a] = low[b] = min(low[a], low[b])
    for group in (1 << 16, 4):  # as one group, and bucket by bucket
        monkeypatch.setattr(minhash_dedup, "GROUP", group)
        got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == low and 1 < len(set(low.values())) < 60


def test_a_text_longer_than_a_block_has_the_words_of_its_parts(monkeypatch):
    random = np.random.default_rng(1)
    text = b" ".join(b"x" * int(n) for n in random.integers(1, 60, 400)) + b"\t" + b"y" * 5000
    whole = list(shingles.shingle_sets([text, b"a b"]))
    monkeypatch.setattr(shingles, "BLOCK_BYTES", 256)
    for one, two in zip(whole, shingles.shingle_sets([text, b"a b"])):
        assert (one == two).all()


def test_language_held_out_accuracy(spark, docs, odd):
    rows = queries.op9_language_id(spark, "/root/testdata/sf0.01").collect()
    real = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r.held_out and real[r.doc_id] and r.lang_pred != "und"]
    assert sum(r.lang_pred == real[r.doc_id] for r in held) >= 0.97 * len(held) > 50
    blank = language.Decoder([], np.zeros((0, language.BUCKETS)))
    assert {r.lang_pred for r in language.predicted(odd.withColumn("held_out", F.lit(True)), blank).collect()} == {"und"}
    one = language.train(odd)
    assert one("123 ...") == ("und", 0.0, True) and one(None)[0] == "und"


def test_language_counts_do_not_depend_on_blocks(monkeypatch):
    text = "ab \u00c9\u0130c  d\n" * 40 + "x"
    whole = language.gram_counts(text)
    for size in (1, 2, 3, 7, 100):
        monkeypatch.setattr(language, "BLOCK_CHARS", size)
        assert (language.gram_counts(text) == whole).all()


def test_toxicity(spark, odd, none):
    labelled = odd.withColumn("low_quality", F.lit(0)).withColumn("toxic", F.lit(None).cast("int"))
    for train_on in (labelled, labelled.limit(0)):
        chain = toxicity.train(train_on, toxicity.CATEGORIES)
        assert toxicity.scored(odd, chain, toxicity.CATEGORIES).count() == len(ODD)
        assert toxicity.clean(odd, chain).count() == len(ODD) and toxicity.clean(none, chain).count() == 0
    rows = {r.doc_id: r.rejected for r in queries.op1_toxicity(spark, "/root/testdata/sf0.01").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert sum(rows[d] for d, t in labels.items() if t == 0) <= 0.01 * len(labels)
    assert sum(rows[d] for d, t in labels.items() if t == 1) >= 0.8 * sum(t == 1 for t in labels.values())


def test_line_dedup(spark, odd, none):
    assert line_dedup.without_boilerplate(none).count() == 0
    assert line_dedup.without_boilerplate(odd).columns == [*odd.columns, "lines_removed"]
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "own one\nShared line"), (2, "shared line \nown two"), (3, f"own three\nshared line\n{long}"), (4, f"{long}\nown four\n--"), (5, "own five\n--"), (6, "own six\n--")]
    docs = spark.createDataFrame([(i, t, f"s{i}") for i, t in rows] + [(7, None, None), (8, "", "s8")], "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in line_dedup.without_boilerplate(docs).collect()}
    assert got == {1: "own one\nShared line", 2: "own two", 3: f"own three\n{long}", 4: "own four\n--", 5: "own five\n--", 6: "own six\n--", 7: None, 8: ""}


def test_line_dedup_equals_a_plain_version(spark, docs):
    """One rule for lines of every length: two distinct sites; a column of the operator's own names gives way or travels."""
    random = np.random.default_rng(4)
    lines = [" ".join(str(w) for w in random.integers(0, 99, n)) for n in (1, 2, 3, 9, 55, 60, 80)] + ["--", " ", "\u00c9t\u00c9"]
    rows = [(i, "\n".join(lines[int(k)] for k in random.integers(0, len(lines), int(random.integers(0, 6)))) + f"\nown {i}", f"s{random.integers(0, 3)}" if i % 7 else None, i) for i in range(60)]
    rows += [(100, "paragraph " * 60, "s1", 0), (101, "paragraph " * 60, "s1", 0), (102, "x\n" * 20_000 + "own", "s1", 0), (103, "x\nend", "s2", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").withColumns({c: F.lit("kept") for c in ("_drop", "_doc", "_row", "one", "at", "lines_removed")})
    seen = collections.defaultdict(list)
    plain = lambda x: x.strip(" ").lower()
    for i, text, site, _ in rows:
        for at, x in enumerate(text.split("\n")):
            seen[plain(x)].append((i, at, site or f"d{i}"))
    goes = lambda i, at, x: any(c.isalnum() for c in x) and len({s for *_, s in seen[plain(x)]}) >= 2 and (i, at) != min(seen[plain(x)])[:2]
    want = {i: "\n".join(x for at, x in enumerate(text.split("\n")) if not goes(i, at, x)) for i, text, *_ in rows}
    got = line_dedup.without_boilerplate(df)
    assert got.columns == [*df.columns[:-1], "lines_removed"]
    got = got.collect()
    assert {r.doc_id: r.text for r in got} == want and all(r._drop == r._doc == "kept" and r.n_chars == len(r.text) for r in got if r.lines_removed)
    assert want[101] == rows[61][1] and want[102].count("x") == 1 and want[103] == "end"


def test_decontamination(spark, odd, none):
    item = "the quick brown fox jumps over the lazy dog while seven wizards mix potions in a very old copper kettle by the sea"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "short")], "item_id long, text string")
    typed = "xx " + item.replace("wizards", "wizzards").replace("copper", "coper").upper() + " yy"
    docs = spark.createDataFrame([(1, typed), (2, "the quick brown fox and other words of no concern"), (3, None), (4, "a " * 5000 + item)], "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()) == [(1, 1), (4, 1)]
    assert sorted(r.doc_id for r in decontamination.clean(docs, bench).collect()) == [2, 3]
    assert decontamination.clean(odd, bench.limit(0)).count() == len(ODD) and decontamination.clean(none, bench).count() == 0


def best_edits(window, text):
    """Least edits for the whole window anywhere in the text, by the plain table."""
    row = np.zeros(len(text) + 1, int)
    for i, c in enumerate(window):
        new = [i + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[j] + 1))
        row = np.array(new)
    return int(row.min())


def test_decontamination_equals_plain_edit_distance(monkeypatch):
    random = np.random.default_rng(6)
    some = lambda n, letters="abcdefgh ": "".join(random.choice(list(letters), n))
    items = [some(n) for n in (13, 20, 30, 60, 100, 150)] + [some(60, "ab"), "ab" * 40, "What is 17?", "of it"]
    texts = []
    for item in items:
        for edits in (0, 1, 2, 4, 7):
            t = list(item)
            for _ in range(edits):
                k = int(random.integers(0, len(t)))
                t[k : k + 1] = random.choice(["", "z", "zz"])
            texts.append(some(40) + " " + "".join(t) + " " + some(30))
    texts += ["ab" * 90, "a" * 300, some(200, "ab"), "profit is", "so of it!"]
    index = decontamination.Windows(list(enumerate(items)))

    def check(index):
        for text in texts:
            text = decontamination.plain(text)
            hits = index.search(text)
            found = {(item, start) for item, start, *_ in hits}
            want = set()
            for w, owners, budget in zip(index.window, index.owners, index.budget):
                if best_edits("".join(map(chr, w)), text) <= budget:
                    want |= set(owners)
            want |= {(8, 0)} if "what is 17?" in text else set()
            want |= {(9, 0)} if f" {items[9]} " in f" {text} ".replace("!", " ") else set()
            assert found == want
            assert all(e <= 4 and best_edits(decontamination.plain(items[i])[s : s + 96], text[a:b]) <= 2 * e + 8 for i, s, a, b, e in hits)

    check(index)
    for name, value in (("ENTRIES", 8), ("SEGMENT", 50)):
        monkeypatch.setattr(decontamination, name, value)
    check(index)
    monkeypatch.setattr(decontamination, "COMMON", 1)
    check(decontamination.Windows(list(enumerate(items))))


def test_decontamination_of_few_letters_ends():
    index = decontamination.Windows([(i, "a" * 200) for i in range(2000)])
    assert len({i for i, *_ in index.search("a" * 2000)}) == 2000
    phrase = "the quick brown fox jumps over the lazy dog "
    random = np.random.default_rng(2)
    assert not decontamination.Windows([(i, phrase + "".join(random.choice(list("abcdef "), 60))) for i in range(3000)]).search(phrase * 100)


def test_html(spark):
    page = (
        "<html><head><title>t</title><script>var a='</p>';</script></head><body><header>top</header><nav><ul><li><a href=x>menu</a></ul></nav>"
        "<div class='side ad'>buy</div><article><h1>Head</h1><p>First &amp;\n second <b>bold<p>Third.</article><div id=comments><p>Great post</p></div><footer>f</footer></body></html>"
    )
    assert html_text.main_text(page) == "Head\nFirst & second bold\nThird."
    rows = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "v", "<p>broken <b"), (4, "w", "<nav>only</nav>")], "page_id long, url string, html string")
    assert {r.page_id: (r.text, r.n_chars) for r in html_text.extracted(rows).collect()}[4] == ("", 0)


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, DIR).collect()
    assert check_layout(rows) and len({r.doc_id for r in rows}) <= spark.read.parquet(f"{DIR}/documents.parquet").count()


def test_embeddings_equal_brute_force(spark):
    found = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").limit(200).collect()
    random, rows = np.random.default_rng(5), []
    for r in found:
        v = np.array(r.embedding)
        for k in range(4):  # the row and noisy copies with cosines on both sides of the threshold
            rows.append((r.vec_id * 4 + k, [float(c) for c in np.float32(v + k * random.normal(size=len(v)) * 0.12 * np.linalg.norm(v) / len(v) ** 0.5)], r.label))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    rows = df.collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r.label for r in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    low = np.array([r.vec_id for r in rows])
    while True:
        new = np.minimum(low, np.where(near, low[None, :], low.max()).min(1))
        if (new == low).all():
            break
        low = new
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {r.vec_id: (int(near[i].sum()), int(low[i]), bool(low[i] == r.vec_id)) for i, r in enumerate(rows)}
    assert 300 < near.sum() < 2000
    assert queries.op2_embedding_near_dedup(spark, "/root/testdata/sf0.01").count() == 500


def test_embeddings_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [1.0, None], 1), (9, [inf, 1.0], 1), (10, [], 1), (11, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (12, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    assert len(got) == len(rows) and got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[11] == (3, 1, False) and got[None] == (3, None, True)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 12))
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embeddings_of_extreme_sizes_and_text_labels(spark):
    rows = [(1, [1e200, 0.0], "a"), (2, [2e200, 0.0], "a"), (3, [1e-200, 0.0], "a"), (4, [3.0, 0.1], "a"), (5, [1e200, 0.0], "b"), (6, [0.0, 5e-324], "a"), (7, [0.0, 1.0], "a"), (8, [1e200, 1e200], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").withColumns({c: F.lit(1) for c in ("id", "print", "cell", "a", "n")})
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (1, 6), 7: (1, 6), 8: (0, 8)}


def test_embeddings_equal_their_sql(spark, tmp_path):
    """Chains of near vectors over cell borders, in few and in many dimensions, with copies and odd vectors."""
    rng = np.random.default_rng(5)
    rows = []
    for dims in (2, 5, 16, 64):
        for _ in range(8):
            v = rng.normal(size=dims)
            for _ in range(int(rng.integers(1, 12))):
                v = v + rng.normal(size=dims) * 0.15 * np.linalg.norm(v) / np.sqrt(dims)
                rows.append((len(rows), v.tolist(), int(rng.integers(0, 2))))
    rows += [(len(rows) + i, v, 0) for i, v in enumerate([rows[0][1], rows[0][1], None, [], [0.0, 0.0], [1.0, None], [float("nan"), 1.0]])]
    path = str(tmp_path / "vectors")
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{path}/*.parquet'")
    want = sorted(con.execute(queries.oracle.OP2_SQL).fetchall())
    got = sorted(tuple(r) for r in embedding_dedup.near_duplicates(spark.read.parquet(path)).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == want
    assert sum(n for _, n, _, _ in want) > 100 and sum(not kept for *_, kept in want) > 20


def test_line_stage_leaves_one_of_each_planted_group(spark):
    """Against a plain version: near copies are one document to the line stage, and near_dedup then finds them."""
    random = np.random.default_rng(11)
    word = lambda: "".join(random.choice(list("abcdefghijklmnop"), 6))
    line = lambda n: " ".join(word() for _ in range(n))
    own = {i: [line(70), line(8), line(90), line(12), line(60)] for i in (1, 10, 20, 30, 40, 50, 60)}
    passage, license = line(55), line(6)
    texts = {i: list(t) for i, t in own.items()}
    texts[2] = texts[3] = texts[4] = own[1]  # exact copies on four sites
    texts[11] = [own[10][0].replace(" ", " x ", 1), *own[10][1:]]  # edited copies
    texts[12] = [*own[10][:4], own[10][4] + " end"]
    for i in (20, 30, 40):  # a passage and a license line of unrelated documents, one of them copied
        texts[i] = [license, *own[i], passage]
    texts[21] = list(texts[20])
    texts[31] = [*texts[30], "more"]
    texts[70] = [license, passage]  # nothing of its own
    docs = spark.createDataFrame([(i, "\n".join(t), "en", f"s{i}", 1) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    stage = corpus_pipeline.drop_boilerplate(spark, docs, "")
    got = {r.doc_id: r.text for r in stage.collect()}
    group = lambda i: i // 10 * 10 if i >= 10 else 1
    want = {}
    for i, t in texts.items():
        groups = {x: sorted({group(d) for d, u in texts.items() if x in u}) for x in t}
        want[i] = "\n".join(x for x in t if len(groups[x]) < 2 or group(i) == groups[x][0])
    assert got == {i: t for i, t in want.items() if t} and 70 not in got
    assert license in got[21] and passage not in got[31] and got[1] == got[4] == "\n".join(own[1])
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, stage, "").collect()) == sorted(own)


def test_line_stage_keeps_links_of_copies(spark, docs):
    by_text = collections.defaultdict(list)
    for r in docs.values():
        if r.text and r.text.strip():
            by_text[r.text].append(r.doc_id)
    stage = corpus_pipeline.drop_boilerplate(spark, spark.read.parquet(f"{DIR}/documents.parquet").select(*corpus_pipeline.COLUMNS), "")
    got = {r.doc_id: r.text for r in stage.collect()}
    groups = [ids for ids in by_text.values() if len(ids) > 1]
    assert groups and all(len({got.get(i) for i in ids}) == 1 for ids in groups)
    assert all(t.strip() for i, t in got.items() if (docs[i].text or "").strip())


def test_sharding_query_writes_whole_records(spark, docs, monkeypatch):
    whole = sharding.write_shards

    def marked(records, *rest):
        assert set(corpus_pipeline.COLUMNS) <= set(records.columns)
        return whole(records.withColumn("text", F.concat("text", F.lit("+"))), *rest)

    monkeypatch.setattr(sharding, "write_shards", marked)
    want = {i: f"{r.text}+".encode() if r.text is not None else b"" for i, r in docs.items()}
    got = {r.doc_id: (r.size, r.text_crc32) for r in queries.op5_sharding(spark, DIR).collect()}
    assert got == {i: (len(t) + 1, zlib.crc32(t)) for i, t in want.items()}


def test_sharding_renames_clashing_columns(spark, odd):
    rows = odd.withColumns({c: F.lit(c) for c in ("slot", "slot_", "grown_shard", "_draw")}).withColumn("size", F.lit(1))
    out = sharding.shuffled_shards(rows, "doc_id", "size", 3)
    assert {"shard_", "slot_", "slot__", "grown_shard_", "_draw", "shard", "slot", "grown_shard"} <= set(out.columns) and len(set(out.columns)) == len(rows.columns) + 3
    assert {(r.slot_, r.slot__) for r in out.collect()} in ({("slot", "slot_")}, {("slot_", "slot")}) and out.count() == len(ODD)


def test_a_bucket_is_shuffled_evenly(spark):
    """Every row comes to every place of its bucket about equally often over seeds."""
    seen = np.zeros((6, 6))
    for seed in range(120):
        for r in sharding.shuffled_shards(spark.range(6).coalesce(1).withColumn("size", F.lit(1)), "id", "size", 1, seed).collect():
            seen[r.id, r.slot] += 1
    assert seen.min() > 5 and ((seen - 20) ** 2 / 20).sum() < 60  # chi squared, 25 degrees of freedom


def test_written_shards_hold_every_text(spark, odd, monkeypatch, tmp_path):
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 1 << 14)
    hot = [(7, f"row {i} " * 30, "en", "h", 1, 1, "") for i in range(3000)] + [(8, "long " * 1_000_000, "en", "h", 1, 1, "")]
    rows = odd.unionByName(spark.createDataFrame(hot, SCHEMA)).drop("shard").withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)) + 1)
    sharding.write_shards(rows, str(tmp_path / "shards"), "doc_id", "size", 4)
    back = spark.read.parquet(str(tmp_path / "shards")).collect()
    assert collections.Counter((r.doc_id, r.text) for r in back) == collections.Counter((r[0], r[1]) for r in ODD + hot)
    assert len({r.shard for r in back if r.doc_id == 7}) == 1
    for s in {r.shard for r in back}:
        assert sorted(r.slot for r in back if r.shard == s) == list(range(sum(r.shard == s for r in back)))


def test_sequences_hold_the_token_ids(spark, odd, none, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    coder, want = Tokenizer.from_file(path), collections.Counter()
    for doc_id, text, *_ in ODD:
        ids = coder.encode(text or "", add_special_tokens=False).ids + [1]
        want.update((doc_id, k // 4096, tuple(ids[k : k + 4096])) for k in range(0, len(ids), 4096))
    got, rows = collections.Counter(), packing.sequences(packing.placed(packing.token_pieces(odd, path))).collect()
    for r in rows:
        whole = np.frombuffer(r.ids, "<u4").tolist()
        assert len(whole) == sum(p.length for p in r.pieces) <= 4096
        got.update((p.doc_id, p.piece, tuple(whole[p.offset : p.offset + p.length])) for p in r.pieces)
    assert got == want and len({r.sequence_id for r in rows}) == len(rows)
    for places, blocks in ((2, 64), (1, 1)):  # several broadcast blocks, and the shuffled join
        monkeypatch.setattr(packing, "PLACES", places)
        monkeypatch.setattr(packing, "BLOCKS", blocks)
        again = packing.sequences(packing.placed(packing.token_pieces(odd.repartition(4), path))).collect()
        assert sum(len(r.pieces) for r in again) == sum(want.values())
    for ids in ([], [1, 65535], [65536, 7]):
        plain = np.array(ids, "<u4").tobytes()
        assert packing.wide(packing.narrow(plain), len(ids)) == plain
    assert packing.sequences(packing.placed(packing.token_pieces(none, path))).count() == 0
    out = packing.packed(packing.token_pieces(odd, path)).collect()
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in out)
    assert collections.Counter((r.doc_id, r.piece, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in out) == want


def test_html_keeps_all_of_an_article():
    long = [f"{i} " + "word " * 120 + "end" for i in range(5)]
    page = (
        "<body><div class=ad>buy</div><article><header class='header'><h1>Title</h1></header><section><h2 id='search'>Intro</h2><p class='side note'>Sixty characters or so of a first paragraph, no more.</p></section>"
        "<section><h2>Rest</h2>" + "".join(f"<p>{t}</p>" for t in long) + "<p><a href=x>A source that is all link</a></p><div class=share>tell</div></section></article><p>outside</body>"
    )
    assert html_text.main_text(page).split("\n") == ["Title", "Intro", "Sixty characters or so of a first paragraph, no more.", "Rest", *long, "A source that is all link"]
    plain = "<div><p><a href=x>link</a></p></div><div><p id=related>" + long[0] + "</p><p><a href=y>more</a></p></div>"
    assert html_text.main_text(plain) == long[0] + "\nmore"


LONG = ["Sentence " * 30 + f"number {i}." for i in range(6)]
MENU = "<ul>" + "".join(f"<li><a href=/{i}>Item {i}</a></li>" for i in range(8)) + "</ul>"
P = lambda some: "".join(f"<p>{x}</p>" for x in some)


@pytest.mark.parametrize(
    ("page", "want"),
    [  # without an article the ratios decide; short sections and linked paragraphs of the content stay
        (f"<body><div>{MENU}</div><div id=x><h2>Title</h2><div>{P(LONG)}</div><div><p>Short.</p><p><a href=x>Source</a></p></div></div><div>{MENU}</div></body>", ["Title", *LONG, "Short.", "Source"]),
        (f"<body>{MENU}<h1>Head</h1>{P(LONG)}<p><a href=a>a</a> <a href=b>b</a></p>{MENU}{MENU}</body>", ["Head", *LONG]),
        # names that only resemble those of other parts; elements that group nothing
        (f"<article><h1>T</h1><section id='side-effects'>{P(LONG[:2])}</section><p class='notice'>Read this.</p><div class='notice-board'><p>Post.</p></div></article>", ["T", *LONG[:2], "Read this.", "Post."]),
        # a teaser beside the text is not the article
        (f"<body><article class=teaser><p>Teaser</p></article>{P(LONG)}</body>", LONG),
        (f"<main><article>{P(LONG[:3])}</article></main><article><a href=x>Other story</a></article>", LONG[:3]),
        # menus left open
        (f"<body><nav>{MENU}<article>{P(LONG)}</article></body>", LONG),
        (f"<body><nav>{MENU}<div>{P(LONG)}</div></body>", LONG),
        # comments, even long ones, and a wrapper whose name misleads
        (f"<article>{P(LONG[:2])}<section class='comments'>{P(LONG)}</section></article>", LONG[:2]),
        (f"<div class='banner'>{P(LONG)}</div><div class=ad>Buy.</div>", LONG),
        ("<article>" + P(["Eight."]) + "".join(f"<div><p>{x}</p></div>" for x in LONG) + P(["a.", "b.", "c.", "d."]) + "</article>", ["Eight.", *LONG, "a.", "b.", "c.", "d."]),
        ("<nav>only</nav>", []),
        ("<div>" * 3000 + "<p>deep" + "</div>" * 10, ["deep"]),
        ("<p>" + "very long " * 200_000, [("very long " * 200_000).strip()]),
        ("<form><p>a</p></form><script>x<p>y", []),
    ],
)
def test_html_regions(page, want):
    assert html_text.main_text(page) == "\n".join(want)


def test_html_of_odd_tables(spark):
    rows = [(1, "u", "<p>a", "x"), (1, "u", "<p>a", "x"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html_text.extracted(df).collect()) == [(0, "", 0), (1, "a", 1), (1, "a", 1)]
    assert html_text.extracted(df.limit(0)).count() == 0
