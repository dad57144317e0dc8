"""The training-data operators against brute force, round trips and edge cases."""

import collections
import hashlib
import math
import random
import time
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from watchloom.llm import bpe, chat_format, components, fingerprints, html_text, language_id, mixing, ngram_join, substring_dedup, text_hash, topk_search, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, doc string, part string"


def table(spark, texts, langs=None):
    """Documents with extra columns whose names the operators use inside."""
    rows = [(k, t, (langs or ["en"] * len(texts))[k], f"s{k % 3}", len(t or ""), "n", "d", "p") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def corpus(n=60, seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 300))) for _ in range(n)]
    passage = " ".join(r.choice(vocabulary) for _ in range(40))
    for k in range(0, n, 2):
        docs[k] += " " + passage
    for k in range(20):
        words = docs[k].split()
        for _ in range(k // 4):
            words[r.randrange(len(words))] = "edit"
        docs.append(" ".join(words))
    return docs + ["", None, "   ", "one", "a b c", "x " * 60, "x " * 60, "Long " + "y" * 20000, docs[0], docs[0]]


def brute_components(texts):
    sets = {}
    for d, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            c = len(sets[a] & sets[b])
            if c and 100 * c >= 75 * (len(sets[a]) + len(sets[b]) - c):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_ngram_components(spark):
    texts = corpus()
    want = brute_components(texts)
    for dense in (2, 16):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(table(spark, texts), dense=dense).collect()}
        assert got == want
    kept = ngram_join.keep_one(table(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in want.values()}) and kept.columns == table(spark, texts).columns


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word[:n]


def twins():
    """Two texts that differ in one long word only, made so that sums of powers of an odd number agree."""
    r, out = random.Random(9), []
    for n in (128, 1024, 4096):
        base = [r.choice(["red", "blue", "green", "one"]) + str(k) for k in range(19)]
        word = thue_morse(n)
        out += [" ".join([*base[:10], w, *base[10:]]) for w in (word, word.translate(str.maketrans("ab", "ba")))]
    # and windows of words in that order
    order = thue_morse(16)
    out += [" ".join([*("xy"["ab".index(c)] for c in o), "p", "q", "r", "s"]) for o in (order, order.translate(str.maketrans("ab", "ba")))]
    return out


def test_hashes_tell_words_apart():
    texts = twins()
    raw, offsets = text_hash.string_buffers(pa.array(texts))
    for size in (5, 20):
        h, ok = text_hash.window_hashes(text_hash.words(raw, offsets), size)
        words = [t.split() for t in texts]
        want = {tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1)}
        assert len(set(h[ok].tolist())) == len(want)
    assert len({text_hash.fold(np.array(x, np.uint64)) for x in ([], [1], [1, 1], [2, 1], [1, 2])}) == 5
    for size in (1, 5, 7, 20):
        some = np.arange(40, dtype=np.uint64)
        assert (text_hash.rolling(some, size) == np.concatenate([text_hash.rolling(some[i : i + size], size) for i in range(41 - size)])).all()


def test_ngram_sends_no_table_through_the_driver(spark):
    """No join of the near-duplicate stage is a broadcast one: the driver would build a table of rows that grow with the input."""
    started = lambda: spark._jsparkSession.sharedState().statusStore().executionsList()
    bus = spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before = started().size()
    texts = corpus()
    kept = {r.doc_id for r in ngram_join.keep_one(table(spark, texts)).collect()}
    bus.waitUntilEmpty()
    plans = [started().apply(k).physicalPlanDescription() for k in range(before, started().size())]
    want = brute_components(texts)
    assert kept == {k for k, (_, least) in want.items() if k == least}
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastExchange" in p for p in plans)


def test_ngram_collisions_and_repeats(spark):
    texts = twins()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(table(spark, texts)).collect()} == brute_components(texts)
    rows = [(1, "a b c d e f"), (1, "x y z"), (None, "x y z"), (None, None), (2, "a b c d e f"), (3, "q")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(1, 2, 1), (1, 1, 1), (None, 1, 1), (None, 0, None), (2, 2, 1), (3, 1, 3)], key=repr)


def test_ngram_large_group(spark, monkeypatch):
    """Hundreds of near copies of one text, and as many texts that share half of their shingles: hot blocks, large stars, crossing pairs."""
    base = [f"v{k}" for k in range(150)]
    texts = [" ".join([*base[: k % 150], f"e{k}", *base[k % 150 + 1 :]]) for k in range(220)]
    texts += [" ".join([*base[:75], *(f"o{k}x{i}" for i in range(75))]) for k in range(120)]
    want = brute_components(texts)
    for parts in (1 << 22, 1 << 12):
        monkeypatch.setattr(ngram_join, "_PART_SHINGLES", parts)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(table(spark, texts)).collect()} == want


def test_ngram_without_bands(spark, monkeypatch):
    """When no seed spreads a set over enough blocks, single shingles are the blocks of all sets."""
    nodes, tried = ngram_join._nodes, []

    def never(docs, size, num, den, seed, small):
        tried.append(small)
        found = nodes(docs, size, num, den, seed, small)
        return found.withColumn("fits", F.lit(False)) if small < 1 << 60 else found

    monkeypatch.setattr(ngram_join, "_nodes", never)
    assert ngram_join._bands(1000, 3, 4, 1 << 62) == [-1] and ngram_join._bands(100, 3, 4, 64) == [0]
    texts = corpus(12)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_components(table(spark, texts)).collect()} == brute_components(texts)
    assert tried[-1] == 1 << 62 and len(tried) == 8


def test_ngram_components_empty(spark):
    assert ngram_join.ngram_components(table(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("block", [1 << 19, 500])
def test_ngram_links(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "_BLOCK_SHINGLES", block)
    texts = corpus()
    base = ["v%d" % k for k in range(120)]
    for k in range(25):  # near copies of one text that link with each other, and a chain whose ends do not
        texts.append(" ".join([*base[:k], "edit", *base[k + 1 :]]))
    texts += [" ".join(f"c{k}" for k in range(s, s + 200)) for s in (0, 20, 40, 60)]
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    linked = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    want = {d: sum(d != k and bool(s) and linked(s, o) for k, o in enumerate(sets)) for d, s in enumerate(sets)}
    got = {r.doc_id: r for r in ngram_join.ngram_components(table(spark, texts), links=True).collect()}
    assert {d: r.n_links for d, r in got.items()} == want and max(want.values()) >= 24
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == brute_components(texts)


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(50, 51), (52, 50), (60, 60)], "u long, v long")
    got = {r.v: r.label for r in components.connected_components(edges).collect()}
    assert got == {**{k: 0 for k in range(31)}, 50: 50, 51: 50, 52: 50}


def brute_dedup(texts, window=20):
    first, words, out = {}, [(t or "").encode().split() for t in texts], {}
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (d, i))
    for d, w in enumerate(words):
        lost = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] != (d, i):
                lost[i : i + window] = [True] * window
        kept = b" ".join(x for x, gone in zip(w, lost) if not gone)
        out[d] = (len(w), sum(lost), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("batches", [1, 2, 6])
def test_substring_dedup(spark, batches):
    texts = corpus()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_digest(table(spark, texts), batches=batches).collect()}
    assert got == brute_dedup(texts)


def test_substring_texts_and_compaction(spark):
    texts = corpus(20)
    docs = table(spark, texts)
    out = substring_dedup.dedup_texts(docs)
    assert out.columns == docs.columns
    want = brute_dedup(texts)
    for r in out.collect():
        assert hashlib.sha256(b" ".join((r.text or "").encode().split())).hexdigest() == want[r.doc_id][2]
    assert substring_dedup.dedup_digest(docs.limit(0)).count() == 0


def spans(rows):
    """Windows that stretches stand for."""
    return {(r.doc, r.start + k) for r in rows for k in range(r.len)}


def brute_spans(texts, window=20):
    first, out = set(), set()
    for d, t in enumerate(texts):
        w = (t or "").encode().split()
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            if g in first:
                out.add((d, i))
            first.add(g)
    return out


@pytest.mark.parametrize("filtered", [10**6, 0])
def test_reopened_index(spark, monkeypatch, tmp_path, filtered):
    """An index opened again, by its folder alone, after each batch; compaction in between; a manifest half written is none."""
    monkeypatch.setattr(substring_dedup, "FILTERED", filtered)
    texts = corpus(20)
    docs, found, index = table(spark, texts), set(), None
    for k in range(4):
        index = substring_dedup.FingerprintIndex(spark, f"{tmp_path}/index", max_runs=2)
        for run in index.runs:
            spark.sql(f"DROP TABLE IF EXISTS {run['name']}")  # as in another session
        (tmp_path / "index/manifest/99").mkdir(parents=True, exist_ok=True)
        part = docs.filter((F.col("doc_id") >= 12 * k) & (F.col("doc_id") < 12 * k + 12))
        found |= spans(index.append(part, docs.filter(F.col("doc_id") < 12 * k)).collect())
        assert len(index.runs) <= 2
    assert index.compactions > 0 and found == brute_spans(texts[:48])


def test_substring_collisions_hot_anchors_and_repeats(spark):
    r = random.Random(4)
    line = " ".join(f"l{k}" for k in range(22))
    texts = [*twins(), *[" ".join(f"{r.randrange(10**6)}" for _ in range(12)) + " " + line + " " + " ".join(f"{r.randrange(10**6)}" for _ in range(30)) for _ in range(120)]]
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring_dedup.dedup_digest(table(spark, texts)).collect()}
    assert got == brute_dedup(texts)
    rows = [(None, line), (1, line), (1, line), (2, None), (2, "")]
    got = sorted(((x.doc_id, x.n_words, x.n_removed) for x in substring_dedup.dedup_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(None, 22, 0), (1, 22, 22), (1, 22, 22), (2, 0, 0), (2, 0, 0)], key=repr)


def test_hot_postings_lie_in_few_files(spark, tmp_path):
    """Each bucket of a run has a file of either kind at most, also where many documents share a line; what a batch finds is written."""
    r = random.Random(8)
    line = " ".join(f"l{k}" for k in range(60))
    docs = table(spark, [f"{r.random()} {line} {r.random()}" for _ in range(600)])
    index, lost = substring_dedup.FingerprintIndex(spark, f"{tmp_path}/index", max_runs=1), set()
    for k in range(2):
        gone = index.append(docs.filter(F.col("doc_id") % 2 == k), docs.filter(F.col("doc_id") % 2 < k))
        lost |= {x.doc for x in gone.collect()}
        assert "MapInArrow" not in gone._jdf.queryExecution().toString()
        for hot in ("true", "false"):
            files = list((tmp_path / "index/runs" / index.runs[-1]["name"] / f"hot={hot}").glob("*.parquet"))
            assert 1 < len(files) <= index.buckets
    assert index.compactions == 1 and len(lost) == 599
    manifest = tmp_path / "index/manifest/99"
    spark.createDataFrame([('{"window": 20, "anchor": 5, "runs": [], "compactions": 0}',)], "value string").coalesce(1).write.text(str(manifest))
    with pytest.raises(ValueError, match="layout"):
        substring_dedup.FingerprintIndex(spark, f"{tmp_path}/index")


def test_language_id(spark):
    r = random.Random(3)
    letters = {"aa": "abcde ", "bb": "efghi ", "cc": "ijklm "}
    texts, langs = [], []
    for k in range(90):
        name = list(letters)[k % 3]
        texts.append("".join(r.choice(letters[name]) for _ in range(200)))
        langs.append(name)
    texts += [None, "", "123 --"]
    langs += ["aa", None, "bb"]
    got = {r.doc_id: r for r in language_id.predict_table(table(spark, texts, langs)).collect()}
    assert all(got[k].lang_pred == langs[k] for k in range(90)) and all(0 <= x.score <= 1 for x in got.values())
    assert {got[k].lang_pred for k in (90, 91, 92)} == {"und"}
    assert all(got[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in got)
    assert {language_id.decode(int(g)) for g in language_id.ngrams("ab-c")[0]} == {"a", "b", "c", "_a", "ab", "b_", "_c", "c_", "_ab", "ab_", "_c_"}


def plain_language(texts, langs, held):
    """Out-of-place distances by counters and lists, without arrays."""

    def grams(t):
        c = collections.Counter()
        for w in "".join(x if x.isalpha() else " " for x in (t or "").lower()).split(" "):
            if w:
                w = f"\x01{w}\x01"
                for n in (1, 2, 3):
                    c.update(w[i : i + n] for i in range(len(w) - n + 1) if w[i : i + n] != "\x01")
        # words that touch share their border
        return c

    def ranks(c, size):
        order = sorted(c, key=lambda g: (-c[g], [0] * (3 - len(g)) + [ord(x) for x in g]))
        return {g: k + 1 for k, g in enumerate(order[:size])}

    known = {}
    for name in sorted({x for x, h in zip(langs, held) if x and not h}):
        total = collections.Counter()
        for t, x, h in zip(texts, langs, held):
            if x == name and not h:
                total += grams(t)
        known[name] = ranks(total, 400)
    out = []
    for t in texts:
        own = ranks(grams(t), 300)
        if not own:
            out.append(("und", 0.0))
            continue
        far = {x: sum(min(abs(p[g] - k), 400) if g in p else 400 for g, k in own.items()) for x, p in known.items()}
        best = min(far, key=lambda x: (far[x], x))
        out.append((best, 1 - far[best] / (400 * len(own))))
    return out


@pytest.mark.parametrize("most", [2000, 2])
def test_language_id_against_plain_profiles(spark, monkeypatch, most):
    monkeypatch.setattr(language_id, "MAX_LANGS", most)
    r = random.Random(8)
    letters = {"aa": "abcdeé", "bb": "cdefgÿ", "cc": "efghiя"}
    texts, langs = [], []
    for k in range(60):
        name = list(letters)[k % 3]
        texts.append(" ".join("".join(r.choice(letters[name]) for _ in range(r.randint(1, 7))) for _ in range(r.randint(1, 60))))
        langs.append(name if k % 7 else None)
    texts += [None, "", "12 - 3", "a" * 200_000, texts[0], texts[0]]
    langs += ["aa", None, "bb", "aa", "bb", "bb"]
    held = [zlib.crc32(str(k).encode()) % 4 == 2 for k in range(len(texts))]
    want = plain_language(texts, langs, held)
    docs = table(spark, texts, langs).withColumn("score", F.lit("clash"))
    got = {x.doc_id: (x.lang_pred, x.score) for x in language_id.predict_table(docs).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in enumerate(want)}
    assert all(abs(got[k][1] - v[1]) < 1e-12 for k, v in enumerate(want))
    assert language_id.predict_table(docs.limit(0)).count() == 0
    none = language_id.predict_table(docs.withColumn("lang", F.lit(None).cast("string")).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("lang", F.lit(None).cast("string")))).collect()
    assert {x.lang_pred for x in none} == {"und"} and len(none) == len(texts) + 1


def plain_anchors(text, k=fingerprints.K, s=fingerprints.S):
    """Places of closed syncmers, from hashes of each substring on its own."""
    code = text_hash.mix64(np.array([ord(c) for c in text], np.uint64) + np.uint64(1))
    inner = [int(text_hash.rolling(code[i : i + s], s)[0]) for i in range(len(text) - s + 1)]
    return [i for i in range(len(text) - k + 1) if min(inner[i : i + k - s + 1]) in (inner[i], inner[i + k - s])]


def test_syncmers_against_plain_ones(spark):
    for text in ["", "a", "ab" * 40, corpus(1)[0][:900], "\U0001f600é" * 30 + corpus(1)[0][:200], thue_morse(300)]:
        where, found = fingerprints.anchors(text)
        assert where.tolist() == (plain_anchors(text) if len(text) >= fingerprints.K else [0] * bool(text))
        if len(text) >= fingerprints.K:
            code = text_hash.mix64(np.array([ord(c) for c in text], np.uint64) + np.uint64(1))
            assert [int(text_hash.rolling(code[i : i + fingerprints.K], fingerprints.K)[0]) for i in where] == found.tolist()
            assert max(np.diff(where), default=0) <= fingerprints.K - fingerprints.S + 1
    bins = fingerprints.sketch(np.array([5, 5 + 128, 6], np.uint64))
    assert (bins != 0xFFFF).sum() == 2
    rows = [(2, "b" * 40), (2, "a" * 40), (None, "c" * 40), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("bucket", F.lit(1))
    got = fingerprints.fingerprint_table(docs).collect()
    assert sorted(((x.doc_id, x.n_chars) for x in got), key=repr) == sorted([(2, 40), (2, 40), (None, 40), (7, 0)], key=repr)
    edited = {x.doc_id: x.edited_sha256 for x in got if x.doc_id != 2}
    # after 7 come the two with 2, then the null id, then 7 again
    assert edited[7] == hashlib.sha256(b"").hexdigest() and edited[None] == hashlib.sha256(b"c" * 20).hexdigest()
    assert fingerprints.fingerprint_table(docs.limit(0)).count() == 0
    places = fingerprints.anchor_table(docs.select("doc_id", F.repeat("text", 3).alias("text"))).collect()
    assert {x.doc_id for x in places} == {2, None}


def test_fingerprints(spark):
    texts = [t for t in corpus(15) if t is not None] + [None]
    docs = {k: t or "" for k, t in enumerate(texts)}
    got = {r.doc_id: r for r in fingerprints.fingerprint_table(table(spark, texts)).collect()}
    order = sorted(docs, reverse=True)
    for i, d in enumerate(order):
        t, n = docs[d], docs[order[(i + 1) % len(order)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert got[d].n_chars == len(t) and got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[d].edited_fingerprint == fingerprints.as_text(fingerprints.fingerprint(edited))
        assert got[d].near_next == fingerprints.likeness(fingerprints.fingerprint(t), fingerprints.fingerprint(n))
    one = fingerprints.fingerprint_table(table(spark, ["abcdefghij" * 5])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    # anchors are context-free: a shared passage gives the same ones at shifted places
    passage = corpus(1)[0]
    pairs = fingerprints.match_positions("abc " + passage, "another start " + passage)
    assert len(pairs) >= len(passage) // 8 and {b - a for a, b in pairs} == {10}
    # places in a passage that repeats are not told apart: its anchors match nothing
    assert len(fingerprints.match_positions("abc " + passage * 3, "another start " + passage * 3)) < len(pairs) // 8


def test_fingerprints_of_long_texts():
    r = np.random.default_rng(1)
    a, b = (r.integers(0, 2**64, 2_200_000, np.uint64) for _ in range(2))
    assert fingerprints.likeness(fingerprints.sketch(a), fingerprints.sketch(b)) < 0.03
    assert fingerprints.likeness(fingerprints.sketch(a), fingerprints.sketch(np.concatenate([a[:1_650_000], b[:550_000]]))) > 0.4


def test_fingerprints_in_chunks(monkeypatch):
    text = corpus(3)[0] * 20
    whole = fingerprints.anchors(text)
    monkeypatch.setattr(fingerprints, "_CHUNK", 100)
    parts = fingerprints.anchors(text)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_chat_fold_and_round_trip(spark):
    log = [(1, 0, "user", "t", 0, "delta", "he"), (1, 0, "user", "t", 1, "delta", "llo"), (1, 1, "assistant", "t", 0, "delta", "bad"), (1, 1, "assistant", "t", 1, "regenerate", "go"), (1, 1, "assistant", "t", 2, "delta", "od"), (1, 2, "user", "t", 0, "delta", "x"), (1, 2, "user", "t", 1, "edit", None), (2, None, None, "t", 0, "delta", "z")]
    events = spark.createDataFrame(log, "conv_id long, turn long, role string, tie string, seq long, kind string, text string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_messages(events)).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nhello\nassistant\ngood\nuser\n\n").hexdigest()
    assert got[1].loss_chars == 4 and got[1].loss_sha256 == hashlib.sha256(b"good").hexdigest() and got[2].n_turns == 1
    for text in ("", "</s>[INST] ok [/INST]", "<|end|>\n<|turn|>user<|says|>", "<\\|end|> <\\\\|x", "[\\INST] \\", "<<SYS>> <</SYS>>"):
        piece, start, end = chat_format.render("assistant", text)
        assert chat_format.parse(piece) == ("assistant", text) and chat_format.unescape(piece[start:end]) == text


def test_chat_query_rows(spark):
    rows = spark.createDataFrame([(5, 1, "assistant", None), (5, 0, "user", "q"), (5, 0, "user", "q"), (6, 0, "assistant", "only")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_messages(chat_format.events_from_messages(rows))).collect()}
    assert got[5].n_turns == 3 and got[5].turns_sha256 == hashlib.sha256(b"user\nq\nuser\nq\nassistant\n\n").hexdigest() and got[6].loss_chars == 4


def test_chat_edges(spark):
    """Null ids are one conversation, a message may be very long, extra columns and empty tables do no harm."""
    long = "y<|end|>" * 200_000
    rows = [(None, 0, "user", "q", 1), (None, 1, "assistant", "a", 2), (3, None, None, None, 3), (3, 2, "assistant", long, 4), (3, 2, "assistant", long, 4)]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq long").withColumn("kind", F.lit("clash")).withColumn("tie", F.lit("x"))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_messages(chat_format.events_from_messages(messages))).collect()}
    assert (got[None].n_turns, got[None].loss_chars) == (2, 1) and got[None].turns_sha256 == hashlib.sha256(b"user\nq\nassistant\na\n").hexdigest()
    assert (got[3].n_turns, got[3].loss_chars) == (3, 2 * len(long)) and got[3].loss_sha256 == hashlib.sha256(2 * long.encode()).hexdigest()
    assert chat_format.read_back(chat_format.format_messages(chat_format.events_from_messages(messages.limit(0)))).count() == 0


def test_top_k(spark):
    r = np.random.default_rng(0)
    x = r.normal(0, 0.2, (700, 8)).astype(np.float32)
    x[300:420] = x[7]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(1000, None), (1100, [float("nan")] * 8), (1200, [1.0, None] + [0.0] * 6), (1300, [0.5] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for row in topk_search.search_table(df).orderBy("query_id", "rank").collect():
        got[row.query_id].append((row.vec_id, row.score))
    whole = np.floor(x.astype(float) * 1024)
    for q in range(0, 700, 100):
        s = whole @ whole[q]
        assert got[q] == [(int(k), int(s[k])) for k in sorted((k for k in range(700) if k != q), key=lambda k: (-s[k], k))[:10]]
    assert set(got) == set(range(0, 700, 100))
    assert topk_search.search_table(df.limit(0)).count() == 0


def clusters(n, seed=3, size=16):
    r = np.random.default_rng(seed)
    return np.floor(1024 * (r.normal(0, 1, (12, size))[r.integers(0, 12, n)] + r.normal(0, 0.05, (n, size))))


def test_cover_tree():
    """Every node covers its rows, children share them out and their centres lie apart, and there are several levels."""
    x, todo, depth = clusters(3000), [], 0
    todo = [(topk_search.cover_tree(x), 1)]
    while todo:
        node, level = todo.pop()
        depth = max(depth, level)
        assert np.sqrt(((x[node.rows] - node.centre) ** 2).sum(1)).max() <= node.radius + 1e-6
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children]).tolist()) == sorted(node.rows.tolist())
            gaps = [np.sqrt(((a.centre - b.centre) ** 2).sum()) for i, a in enumerate(node.children) for b in node.children[:i]]
            assert min(gaps) > node.radius / 2 - 1e-6
            todo += [(c, level + 1) for c in node.children]
        else:
            assert len(node.rows) <= topk_search.LEAF or node.radius == 0
    assert depth >= 3


def test_dual_search_prunes():
    x, seen = clusters(4000), {}
    q = x[::40]
    row, hit, score = topk_search.dual_search(q, np.arange(0, 4000, 40), np.full(100, -np.inf), x, np.arange(4000), 10, seen)
    whole = q @ x.T
    whole[np.arange(100), np.arange(0, 4000, 40)] = -np.inf
    for k in range(100):
        best = sorted(range(4000), key=lambda j: (-whole[k, j], j))[:10]
        assert hit[row == k].tolist() == best and score[row == k].tolist() == whole[k, best].tolist()
    assert seen["cut"] > 100 and seen["scored"] < 0.4 * whole.size


def test_dual_search_scores_in_bulk():
    """Without structure to cut by, pairs are scored some hundreds at a time."""
    x, seen = np.floor(np.random.default_rng(4).normal(0, 200, (4000, 64))), {}
    row, hit, score = topk_search.dual_search(x[::40], np.arange(0, 4000, 40), np.full(100, -np.inf), x, np.arange(4000), 10, seen)
    whole = x[::40] @ x.T
    whole[np.arange(100), np.arange(0, 4000, 40)] = -np.inf
    for k in range(100):
        assert hit[row == k].tolist() == sorted(range(4000), key=lambda j: (-whole[k, j], j))[:10]
    assert seen["scored"] > 200 * seen["products"]


def test_top_k_in_blocks(spark, monkeypatch):
    """Many small blocks: pairs are cut before any rows meet, and the result is that of brute force."""
    monkeypatch.setattr(topk_search, "DATA_BLOCK", 60)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 8)
    pairs, left = topk_search._block_pairs, []
    monkeypatch.setattr(topk_search, "_block_pairs", lambda q, d: left.append((q.count() * d.count(), pairs(q, d))) or left[-1][1])
    x = clusters(1500) / 1024
    x[:300] = x[1]  # equal vectors fill more than a block
    x[1::5] *= 0.3
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(2000 + k, [1.0 * k, 2.0]) for k in range(3)], "vec_id long, embedding array<double>").withColumn("block", F.lit("b")).withColumn("cell", F.lit(1))
    got = collections.defaultdict(list)
    for row in topk_search.search_table(df, 20).orderBy("query_id", "rank").collect():
        got[row.query_id].append((row.vec_id, row.score))
    whole = np.floor(x * 1024)
    for q in range(0, 1500, 20):
        s = whole @ whole[q]
        assert got[q] == [(int(k), int(s[k])) for k in sorted((k for k in range(1500) if k != q), key=lambda k: (-s[k], k))[:10]]
    assert [v for v, _ in got[2000]] == [2001, 2002] and left[0][1].count() < 0.6 * left[0][0]


def test_data_blocks_meet_many_query_blocks(spark):
    """A data block travels once for some thousands of query rows, not once for each query block; no pair is lost or doubled."""
    pairs = spark.createDataFrame([(2, f"{p:02}", b, 1.0, 16 if b == "x" else 400) for p in range(40) for b in "xyz"], "size int, part string, block string, bound double, n long")
    got = topk_search._bundles(pairs, 8192).collect()
    assert sorted((r["size"], r.part, r.block) for r in got) == sorted((2, f"{p:02}", b) for p in range(40) for b in "xyz")
    held = collections.Counter()
    for r in got:
        held[r.block, r.bundle] += 16 if r.block == "x" else 400
    assert held == {("x", 0): 640, ("y", 0): 8400, ("y", 1): 7600, ("z", 0): 8400, ("z", 1): 7600}


def test_top_k_repeats(spark):
    df = spark.createDataFrame([(100, [1.0, 2.0]), (100, [1.0, 3.0]), (1, [1.0, 1.0]), (1, [2.0, 2.0]), (2, [])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk_search.search_table(df).orderBy("rank").collect()]
    assert got == [(100, 1, 1, 6 * 1024**2), (100, 2, 1, 3 * 1024**2)]


def test_pieces_are_split_once():
    """Repeated pieces between white space are lower-cased and split once, with the ids of the text as a whole."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    codec, plain, seen = bpe.BpeCodec(spec), bpe.BpeCodec(spec), []
    plain.piecewise = False
    count = lambda split: types.SimpleNamespace(findall=lambda t: seen.append(len(t)) or split.findall(t))
    codec.split, codec.split_ascii = count(codec.split), count(codec.split_ascii)
    text = "It's  Ελλάς,\u00a0e\u0301t\u00e9\u3000x\x85y \n" * 500
    assert codec.encode(text) == plain.encode(text) and sum(seen) < 40
    for odd in ("", " ", "a\x1cb a\x1c'S", "\u200b\ufeff q", "' S's 's", "\u0301 \u0301a", "z" * 300 + " " + "z" * 300, "<|endoftext|>a <|endoftext|>", "\x00\x7f 9"):
        assert codec.encode(odd) == plain.encode(odd)


def test_mixing_plan():
    totals = {"a": 1000, "b": 100, "c": 10, None: 0}
    p = mixing.plan(totals, target_entropy=0.8, max_epochs=100)
    assert abs(mixing.entropy(p.weights) - 0.8 * math.log(3)) < 1e-6 and p.weights[None] == 0
    q = mixing.plan(totals, target_entropy=1.0, max_epochs=3.0)
    assert max(q.weights[s] * q.budget / t for s, t in totals.items() if t) <= 3.0 + 1e-6
    k = mixing.plan(totals, max_epochs=2.0, keep_all=True)
    assert min(k.weights[s] * k.budget / t for s, t in totals.items() if t) >= 1 - 1e-6


def test_mixing_draws(spark):
    texts = [" ".join(["w"] * (1 + k % 7)) for k in range(300)] + [None, ""]
    docs = table(spark, texts).withColumn("source", F.when(F.col("doc_id") < 220, "big").when(F.col("doc_id") < 290, "mid").when(F.col("doc_id") < 300, "tiny"))
    drawn = mixing.mix(docs, max_epochs=4.0).collect()
    p = mixing.plan(mixing.source_totals(docs), max_epochs=4.0)
    for s, w in p.weights.items():
        own = sorted((x for x in drawn if x.source == s), key=lambda x: x._start)
        starts = np.cumsum([0] + [x._tokens for x in own])[:-1] if own else []
        assert [x._start for x in own] == list(starts) and all(x._start < math.floor(w * p.budget) for x in own if w)
        assert max(collections.Counter((x.doc_id, x._epoch) for x in own).values(), default=1) == 1
    assert {x.doc_id for x in mixing.mix(docs, max_epochs=2.0, keep_all=True).collect()} == set(range(302))


def brute_draws(rows, totals, quotas, seed=0, keep_all=False):
    """``(doc_id, epoch, start)`` of every draw, source by source and epoch by epoch."""
    out = []
    for s, quota in quotas.items():
        own = [(d, t) for d, t, x in rows if x == s]
        total, epoch = totals[s], 0
        while True:
            start = epoch * total
            order = sorted(own, key=lambda x: (hashlib.md5(f"{seed}:{epoch}:{x[0]}".encode()).hexdigest(), x[0]))
            for d, t in order:
                if start < quota or epoch == 0 and (not total or keep_all):
                    out.append((d, epoch, start))
                start += t
            epoch += 1
            if not total or epoch * total >= quota:
                break
    return sorted(out)


@pytest.mark.parametrize("keep_all", [False, True])
def test_mixing_against_brute_force(spark, monkeypatch, keep_all):
    r = random.Random(6)
    texts = [" ".join(["w"] * r.choice([0, 1, 3, 9])) for _ in range(260)]
    sources = [r.choice(["big"] * 12 + ["mid"] * 3 + ["tiny", None]) if k < 255 else "bare" for k in range(260)]
    texts[255:] = ["", None, " ", "", ""]
    docs = spark.createDataFrame([(k, t, s, "x", k) for k, (t, s) in enumerate(zip(texts, sources))], "doc_id long, text string, source string, _order string, _bucket long")
    limits = {"max_epochs": 2.0, "keep_all": True} if keep_all else {"max_epochs": 3.0}
    totals = mixing.source_totals(docs)
    p = mixing.plan(totals, **limits)
    quotas = {s: max(math.floor(w * p.budget), totals[s] if keep_all else 0) for s, w in p.weights.items()}
    rows = [(k, len((t or "").split()), s) for k, (t, s) in enumerate(zip(texts, sources))]
    want = brute_draws(rows, totals, quotas, keep_all=keep_all)
    plain = docs.drop("_order", "_bucket")
    for most in (100_000, 2):  # totals on the driver, and as a table
        monkeypatch.setattr(mixing, "MAX_SOURCES", most)
        got = mixing.mix(plain, **limits).collect()
        assert sorted((x.doc_id, x._epoch, x._start) for x in got) == want
        assert all(x._block == (int(x._start // (p.weights[x.source] * mixing.BLOCK_TOKENS)) if p.weights[x.source] else 0) for x in got)
        assert all(x._order == hashlib.md5(f"0:{x._epoch}:{x.doc_id}".encode()).hexdigest() and x._tokens == rows[x.doc_id][1] for x in got)
    if keep_all:
        assert {d for d, *_ in want} == set(range(260))
    assert mixing.mix(plain.limit(0), **limits).count() == 0


def test_mixing_repeated_rows(spark):
    rows = [(1, "a b", "s")] * 3 + [(1, "a", "s"), (None, "a b c", "t"), (2, "x " * 9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, keep_all=True, max_epochs=2.0).collect()
    assert collections.Counter((x.doc_id, x.text) for x in got if x._epoch == 0) == collections.Counter((d, t) for d, t, _ in rows)
    assert len({(x.source, x._epoch, x._start) for x in got}) == len(got)


PAGE = """<html><head><title>no</title><style>p{}</style></head><body><header>Site</header><nav><ul><li><a href=x>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site for all of you</div><article><h1>A title</h1><p>First &amp; long enough text that is in the article and has
many words of the kind<br>that stop words are.<p>Short one.<script>var x = "<p>no</p>";</script><p><b>bold</b>er</p><div id="comments"><p>A reader said that this is a comment of some length</p></div>
<aside>Other news</aside></article><form>Search</form><footer>&copy; all</footer></body></html>"""


def test_html():
    assert html_text.main_text(PAGE) == "A title\n\nFirst & long enough text that is in the article and has many words of the kind that stop words are.\n\nShort one.\n\nbolder"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p") == html_text.main_text("<!-- x") == ""
    assert html_text.main_text("<article><p>cut &am") == "cut &am"
    plain = "<div><a href=a>Menu</a></div><p>" + "The text of a page that has no article is found by its length and stop words. " * 3 + "</p><p>Tiny.</p><div><a href=b>More</a></div>"
    assert html_text.main_text(plain).endswith("\n\nTiny.")


RICH = "The text of this part is as long as that of an article and it has the words which are in it."
WRAPS = [
    f'<p style="overflow:hidden">{RICH}</p>', f'<p title="the hidden gem">{RICH}</p>', f'<p data-id="ad">{RICH}</p>', f'<div class="content has-sidebar"><article><p>{RICH}</p></article></div>',
    f'<div class="sidebar-page"><article><p>{RICH}</p></article></div>', f'<div id="no-comments"><p>{RICH}</p></div>', f'<article><p><a href="x">{RICH}</a></p><p>{RICH}</p></article>',
    f'<div class=nav data-x=/a/>Menu of the site</div><p>{RICH}</p>', f'<div class="main-content shared"><p>{RICH}</p></div>', f'<div class="text_with_comments"><p>{RICH}</p></div>',
    f'<article><header><h2></h2></header><p class="lead">{RICH}</p></article>', f'<svg/><p>{RICH}</p>', f'<p>{RICH}</p><svg><path d="M0"/><text>no</text></svg>',
]
GONE = [
    '<div class="cookieNotice">{}</div>', '<div class="comment-list">{}</div>', '<ul id=related_posts><li>{}</li></ul>', '<div class="x ad-slot-3">{}</div>', '<div role=navigation>{}</div>', '<div hidden>{}</div>',
    '<p style="color:red; display : none">{}</p>', '<form>{}</form>', '<aside>{}</aside>', '<div aria-hidden="true">{}</div>', '<script>{}</script>', '<header>{}</header>', '<footer><p>{}</p></footer>',
]


def test_html_attributes():
    for page in WRAPS:
        want = "\n\n".join([RICH] * page.count(RICH))
        assert html_text.main_text(page) == want, page
    other = "It is a line of words that is in a part which is not the text of the page at all."
    for wrap in GONE:
        assert html_text.main_text(wrap.format(other) + f"<article><p>{RICH}</p></article>") == RICH, wrap
        assert html_text.main_text(f"<p>{RICH}</p>" + wrap.format(other)) == RICH, wrap


def test_html_density_decides():
    short, links = "A few words", '<p><a href="a">One more of the pages</a> <a href="b">and another of them</a></p>'
    # no article: short blocks go with the nearest decided ones, links and text
    page = f"{links}<p>{short} one</p>{links}<div><p>{RICH}</p><p>{short} two</p><p>{RICH}</p></div><p>{short} three</p>{links}{links}"
    assert html_text.main_text(page) == f"{RICH}\n\n{short} two\n\n{RICH}\n\n{short} three"
    # an article keeps its short and its linked blocks; dense text outside is none of it
    page = f"<p>{RICH} Outside.</p><article><h1>{short}</h1>{links}<p>{RICH}</p><p>{RICH}</p></article><p>{short}</p>"
    assert html_text.main_text(page) == f"{short}\n\nOne more of the pages and another of them\n\n{RICH}\n\n{RICH}"
    # an article that holds next to nothing of the page's dense text is not its main part
    page = "<article><p>Teaser.</p></article>" + f"<div><p>{RICH}</p></div>" * 3
    assert html_text.main_text(page).count(RICH) == 3


def plain_labels(found):
    """The two passes, block by block, without any shortcut."""
    rich = [len(t) >= 140 or len(t) >= 40 and sum(w.strip(".,;:!?\"'()") in html_text.STOP_WORDS for w in t.lower().split()) >= 0.2 * len(t.split()) for t, *_ in found]
    mass = lambda test: sum(len(b[0]) for b, r in zip(found, rich) if r and not b[2] and b[1] <= len(b[0]) / 2 and test(b))
    scoped = any(b[3] and not b[2] for b in found) and mass(lambda b: b[3]) >= 0.25 * mass(lambda b: True)
    first = []
    for b, r in zip(found, rich):
        score = -2 if b[1] > len(b[0]) / 2 else 2 if r else 0
        score += (1 if b[3] else -3) if scoped else 0
        first.append("no" if b[2] else "yes" if score >= 2 else "no" if score <= -2 else "?")
    out = []
    for i, b in enumerate(found):
        same = [j for j, c in enumerate(found) if not scoped or c[3] == b[3] and not (b[3] and c[2])]
        if first[i] != "?":
            out.append(first[i] == "yes")
            continue
        near = sorted((abs(same.index(i) - k), k, j) for k, j in enumerate(same) if first[j] != "?")
        out.append(first[near[0][2]] == "yes" if near else scoped and b[3])
    return out


def test_html_labels_against_plain_rules():
    r = random.Random(2)
    for _ in range(400):
        found = []
        for _ in range(r.randint(0, 14)):
            text = " ".join(r.choice(["the", "of", "and", "stone", "river", "light"]) for _ in range(r.choice([1, 2, 6, 14, 40])))
            found.append((text, r.choice([0, 0, 0, len(text)]), r.random() < 0.15, r.random() < 0.5))
        assert html_text.labels(found) == plain_labels(found)


@pytest.mark.parametrize("piece", ["<b>", "<a href=x>", "<div>", "<p>x", "<div class='sidebar'>", "</i>", '<b title="', "<i a='", "<!-", "<b =", "</", "<script", "<b\n", "&amp", "<td>", "<svg/>"])
def test_html_is_linear(piece):
    """Times of a page and one four times as long; any growth beyond eightfold fails."""
    took = []
    for n in (10_000, 40_000):
        page = f"<article><p>{RICH}</p>" + piece * n + "<p>end</p></article>"
        began = time.perf_counter()
        html_text.main_text(page)
        took.append(time.perf_counter() - began)
    assert took[1] < 2 and took[1] < 8 * took[0] + 0.2


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None)], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.extract_table(df.withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(1))).collect()}
    assert html_text.extract_table(df.limit(0)).count() == 0 and html_text.extract_table(df.union(df)).count() == 4
    assert got[1].n_chars == len(got[1].text) and got[2].text == "" and got[2].n_chars == 0


def test_bpe(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    texts = ["Hello <|endoftext|> World", "", None, "  ", "don't WE'LL 日本語 é ﬁ 12345", "ΑΣ İ ẞ", "\U0001f600\U0001f600 x", "a\x00b", "x" * 3000, "!?" * 300, "<|startoftext|>", *corpus(10)]
    got = {r.doc_id: r for r in bpe.digest_table(table(spark, texts), path).collect()}
    for k, t in enumerate(texts):
        e = library.encode(t or "", add_special_tokens=False)
        assert got[k].n_tokens == len(e.ids) and got[k].ids_sha256 == hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(library.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()
    full = bpe.encode_table(table(spark, texts), path)
    assert full.filter("size(tokens) > 0").count() == sum(bool(library.encode(t or "", add_special_tokens=False).ids) for t in texts)


def test_bpe_code_points():
    """Every assigned plane's code points, between letters and next to digits, as the library has them."""
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    library, codec = Tokenizer.from_file(path), bpe.BpeCodec(spec)
    points = [c for c in range(1, 0x34000) if not 0xD800 <= c < 0xE000] + list(range(0xE0000, 0xE0200))
    for at in range(0, len(points), 64):  # one text for many, and each alone where it differs
        some = "".join(f"a{chr(c)}b1{chr(c)} " for c in points[at : at + 64])
        assert codec.encode(some) == np.array(library.encode(some, add_special_tokens=False).ids, "<u4").tobytes(), hex(points[at])
    assert codec.encode_all(["a b", None, "a b", ""]) == [codec.encode("a b"), b"", codec.encode("a b"), b""]
    with pytest.raises(ValueError):
        bpe.BpeCodec(spec.replace('"type":"NFC"', '"type":"Nmt"').replace('"type": "NFC"', '"type": "Nmt"'))


def test_bpe_table_edges(spark):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    assert bpe.digest_table(table(spark, ["x"]).limit(0), path).count() == 0
    docs = table(spark, ["word " * 300_000, "a", "a"]).withColumn("tokens", F.lit("clash"))
    got = bpe.encode_table(docs, path).select("doc_id", F.size("tokens").alias("n"), "node").collect()
    assert {r.doc_id: r.n for r in got} == {0: 300_000, 1: 1, 2: 1}


def test_toxicity(spark):
    r = random.Random(5)
    words = [f"word{i}" for i in range(80)]
    texts, labels = [], []
    for k in range(240):
        t = [r.choice(words) for _ in range(r.randint(5, 150))]
        if k % 4 == 0:
            t[r.randrange(len(t))] = r.choice(["vile", "nasty"])
        texts.append(" ".join(t))
        labels.append((k, int(k % 4 == 0)))
    texts += ["", None]
    got = {x.doc_id: x for x in toxicity.score_table(table(spark, texts), spark.createDataFrame(labels + [(7, None), (9999, 1)], "doc_id long, toxic int")).collect()}
    assert len(got) == len(texts) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got.values())
    held = [k for k in range(240) if got[k].held_out]
    assert sum(got[k].predicted == labels[k][1] for k in held) >= 0.9 * len(held)
    assert got[240].score == got[241].score


def plain_forward(net, text):
    """The score of a text window by window and step by step, in scalars of Python's own."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    sig = lambda x: 1 / (1 + np.exp(-x))
    words = "".join(c if ord(c) >= 128 or c.isalnum() else " " for c in text).lower().split()
    best = -np.inf
    for at in range(0, max(1, len(words) - toxicity.WINDOW + toxicity.STEP), toxicity.STEP):
        xs = []
        for w in words[at : at + toxicity.WINDOW]:
            t = toxicity.read(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))
            hit = np.flatnonzero(net.vocabulary == t.hashes[0])
            xs.append(np.concatenate([p["word"][hit[0] + 1 if len(hit) else 0], p["char"][t.gram].mean(0)]))
        H, states = toxicity._HIDDEN, []
        for k, order in (("f", range(len(xs))), ("b", range(len(xs) - 1, -1, -1))):
            h, out = np.zeros(H), {}
            for i in order:
                g = xs[i] @ p[f"X{k}"] + p[f"c{k}"]
                z, r = sig(g[:H] + h @ p[f"U{k}"][:, :H]), sig(g[H : 2 * H] + h @ p[f"U{k}"][:, H : 2 * H])
                c = np.tanh(g[2 * H :] + (r * h) @ p[f"U{k}"][:, 2 * H :])
                h = out[i] = (1 - z) * h + z * c
            states.append([out[i] for i in range(len(xs))])
        both = [np.concatenate(x) for x in zip(*states)]
        e = np.array([np.tanh(s @ p["A"]) @ p["v"] for s in both])
        a = np.exp(e - e.max()) / np.exp(e - e.max()).sum() if len(e) else e
        pooled = sum((w * s for w, s in zip(a, both)), np.zeros(2 * H))
        best = max(best, float(pooled @ p["w"] + p["b"][0]))
    return sig(best)


def test_network_against_plain_steps_and_numeric_gradients():
    r = random.Random(3)
    texts = [" ".join(r.choice(["one", "Two", "thrée", "vile-four", "5x"]) for _ in range(n)) for n in (1, 3, 30, 48, 49, 72, 73, 200)] + ["", "..."]
    net = toxicity.fit(texts * 6, np.array(([1, 0] * 5) * 6), rounds=2)
    raw, off = text_hash.string_buffers(pa.array(texts))
    got = toxicity._sigmoid(net.documents(toxicity.read(raw, off), len(texts)))
    assert np.abs(got - [plain_forward(net, t) for t in texts]).max() < 1e-4
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    t = toxicity.read(raw, off)
    which, y = np.array([0, 2, 5]), np.array([1.0, 0.0, 1.0])

    def loss():
        logit = net.forward(net.inputs(t)[0], *net.gather(t, which))[0].astype(np.float64)
        return float(np.mean(np.log1p(np.exp(-logit)) * y + np.log1p(np.exp(logit)) * (1 - y)))

    g = net.gradients(t, which, y)
    for name in ("w", "b", "A", "v", "Xf", "Ub", "cf", "cb", "Uf", "Xb"):
        at = tuple(r.randrange(n) for n in net.p[name].shape)
        kept, step = net.p[name][at], 1e-3
        net.p[name][at] = kept + step
        up = loss()
        net.p[name][at] = kept - step
        down = loss()
        net.p[name][at] = kept
        assert abs((up - down) / (2 * step) - g[name][at]) < 2e-4, name


def test_toxicity_sample(spark):
    """Bounded in rows and bytes with whole texts; both labels make a toxic document; repeated ids push out nobody."""
    texts = [f"text {k} " + "word " * (k % 5) for k in range(100)] + ["long " * 5000]
    docs = table(spark, texts).unionByName(table(spark, ["text 0 "] * 300).withColumn("doc_id", F.lit(1).cast("long")))
    labels = spark.createDataFrame([(k, k % 2) for k in range(101)] + [(2, 1)], "doc_id long, toxic int")
    got, toxic = toxicity.training_sample(docs, labels, size=10, most=400)
    assert toxic.tolist().count(0) == 10 and toxic.tolist().count(1) == 10 and set(got) <= set(texts)
    every, toxic = toxicity.training_sample(docs, labels)
    own = [k for k in range(101) if zlib.crc32(str(k).encode()) % 5]
    assert sorted(x for x in every if x != "text 0 ") == sorted(texts[k] for k in own if k)
    assert dict(zip(every, toxic)).get(texts[2]) in (None, 1.0)
    assert toxicity.score_table(docs.limit(0), labels).count() == 0


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {x.predicted for x in toxicity.score_table(table(spark, ["a b", None]), none).collect()} == {0}


def brute_pipeline(rows):
    """The pipeline on ``(doc_id, text, lang, source)`` by plain loops."""
    import public_tokenizers
    from tokenizers import Tokenizer

    found = plain_language([r[1] for r in rows], [r[2] for r in rows], [zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in rows])
    kept = [(d, t, x or p, s) for (d, t, x, s), (p, _) in zip(rows, found) if p != "und" and x in (None, p)]
    component = brute_components([r[1] for r in kept])
    kept = [r for k, r in enumerate(kept) if component[k][1] == k]
    texts = [r[1] for r in kept]
    cut = []
    first, words = set(), [t.encode().split() for t in texts]
    for (d, t, x, s), w in zip(kept, words):
        lost = [False] * len(w)
        for i in range(len(w) - 19):
            g = tuple(w[i : i + 20])
            if g in first:
                lost[i : i + 20] = [True] * 20
            first.add(g)
        cut.append((d, b" ".join(x for x, gone in zip(w, lost) if not gone).decode() if any(lost) else t, x, s))
    totals = collections.Counter()
    for _, t, _, s in cut:
        totals[s] += len(t.encode().split())
    p = mixing.plan(dict(totals), max_epochs=2.0, keep_all=True)
    quotas = {s: max(math.floor(w * p.budget), totals[s]) for s, w in p.weights.items()}
    draws = brute_draws([(d, len(t.encode().split()), s) for d, t, _, s in cut], totals, quotas, keep_all=True)
    library, by_id = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {r[0]: r for r in cut}
    return sorted((d, by_id[d][1], by_id[d][2], by_id[d][3], len(by_id[d][1]), tuple(library.encode(by_id[d][1], add_special_tokens=False).ids)) for d, _, _ in draws)


def test_pipeline_against_brute_force(spark, tmp_path):
    texts = corpus(24)
    rows = [(k, t, [None, "en", "en", "de"][k % 4], f"s{k % 3 if k % 2 else 0}") for k, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(d, t, x, s, len(t or "")) for d, t, x, s in rows], schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.text, r.lang, r.source, r.n_chars, tuple(r.tokens)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    # a text that loses nothing keeps its characters, so n_chars is that of the text in all cases
    assert got == brute_pipeline(rows) and len(got) > 20


def test_pipeline_edges(spark):
    """Nulls in any column, repeated rows, clashing names, and an empty table, stage by stage."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _label string, node string, tokens string"
    rows = [(None, "a b c d e f g", None, None, None, "x", "n", "t"), (1, None, None, "s", 0, "x", "n", "t"), (2, "one two three four five six", "en", "s", 27, "x", "n", "t"), (2, "one two three four five six", "en", "s", 27, "x", "n", "t"), (3, "", "en", None, 0, "x", "n", "t"), (4, "w " * 30_000, "en", "s", 60_000, "x", "n", "t")]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        count = docs.count()
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = substring_dedup.materialise(stage(spark, docs, ""))
            assert set(docs.columns) <= set(out.columns) and (k == 4 or out.columns == docs.columns)
            if k < 2:
                assert {r.doc_id for r in out.collect()} == ({None, 2, 4} if count else set())
            docs = out
        assert docs.filter("n_tokens != size(tokens)").count() == 0 and (docs.count() > 0) == (count > 0)
