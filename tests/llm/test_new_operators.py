"""Suffix tree, spelling variants and centroid clustering against plain versions and edge cases."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from watchloom.llm import html_text, spelling, subvector_kmeans, suffix_tree_lm, toxicity

NAMES = "word n near near_n form root key context suffix value kind slice held ids codes cluster what id v h"
SCHEMA = "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in NAMES.split())


def table(spark, rows):
    """``(id, text)`` rows with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(k, t, "en", *["x"] * len(NAMES.split())) for k, t in rows], SCHEMA)


def rows(df):
    return [r.asDict() for r in df.collect()]


# ---- spelling


def plain_words(docs):
    n = collections.Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 5}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = {}
    for w in n:
        end = w
        while form[end]:
            end = form[end]
        out[w] = (form[w], end, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def variant_docs():
    r = random.Random(4)
    base = ["abcdefg", "aaaaaa", "bananas", "éclàirs", "ZÜRICHER", "mississippi", "thousand"]
    said = []
    for w in base:
        said += [w] * r.choice((5, 30, 180))
        for _ in range(12):
            k, c = r.randrange(len(w)), r.choice("abzé")
            v = r.choice((w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]))
            said += [v] * r.choice((1, 5, 6, 25))
            v = v[:1] + "q" + v[1:]
            said += [v] * 5
    r.shuffle(said)
    docs = [(k, " ".join(said[k::40])) for k in range(40)]
    return docs + [(40, None), (41, ""), (42, "12 ... !"), (43, "tiny words of few"), (None, "thousand thousand"), (7, "bananas-bananas"), (44, "y" * 3000 + " "), *[(45 + k, "x" * 2999 + " ") for k in range(5)], *[(50 + k, "x" * 3000) for k in range(5)]]


def test_spelling_is_plain(spark):
    docs = variant_docs()
    expect = plain_variants(plain_words(docs))
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows(spelling.variant_table(table(spark, docs)))}
    assert got == expect
    assert any(f and f != r for f, r, *_ in got.values())  # a chain
    assert got["x" * 2999][3] == 1


def test_spelling_in_many_passes(spark):
    n = plain_words(variant_docs())
    vocabulary = spark.createDataFrame(list(n.items()), "word string, n long")
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows(spelling.variants(vocabulary, filter_bytes=600))}
    assert got == plain_variants(n)
    shards = spelling.passes({6: 10_000, 7: 3, 8: 40}, 2048)
    assert len(shards) > 10 and all(sum(s[3] for s in one) <= 256 for one in shards)
    assert {s[1] for one in shards for s in one if s[0] == 6} == set(range(next(s[2] for one in shards for s in one if s[0] == 6)))


def test_spelling_without_words(spark):
    for docs in ([], [(1, None), (2, "a b")]):
        out = spelling.variant_table(table(spark, docs))
        assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and not out.collect()


# ---- clustering


def plain_clusters(vectors, k=8, rounds=10, dims=64):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centres = [v for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        own = [[] for _ in centres]
        for _, v in kept:
            own[near(v)[1]].append(v)
        centres = [[sum(x) // len(g) for x in zip(*g)] if g else c for g, c in zip(own, centres)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    each = collections.Counter()
    for _, c, d in found:
        each[c] += d
    return sorted(((i, c, d, each[c], sum(each.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in found), key=repr)


def vectors(spark, rows_):
    return spark.createDataFrame([(i, v, 1, "x", "x", "x") for i, v in rows_], "vec_id long, embedding array<double>, label int, ids string, cluster string, blocks string")


def clustered(df, **options):
    return sorted((tuple(r) for r in subvector_kmeans.cluster_table(df, **options).collect()), key=repr)


def cloud(n=300, seed=2):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, 64))
    out = [(k, (centres[k % 5] + 0.3 * r.normal(size=64)).tolist()) for k in range(n)]
    same = out[0][1]
    out += [(n + k, same) for k in range(150)]  # a third is one vector
    odd = list(same)
    return out + [(900, None), (901, same[:63]), (902, [*same[:63], None]), (903, [*same[:63], math.inf]), (904, [*same[:63], math.nan]), (None, odd), (5, out[7][1]), (5, out[5][1])]


def test_clusters_are_plain(spark):
    data = cloud()
    assert clustered(vectors(spark, data).repartition(3)) == plain_clusters(data)


def test_clusters_of_large_numbers(spark):
    r = random.Random(1)
    data = [(k, [r.choice((-1, 1)) * 2.0 ** r.randint(0, 19) + r.random() if j == k % 64 else r.random() for j in range(64)]) for k in range(40)]
    assert clustered(vectors(spark, data)) == plain_clusters(data)
    huge = clustered(vectors(spark, [(k, [1e300 * (k % 2)] * 64) for k in range(20)]))
    assert len(huge) == 20 and all(0 <= row[2] < 2**63 for row in huge)


def test_clusters_with_few_vectors(spark):
    few = [(k, [float(k)] * 64) for k in range(3)]
    assert clustered(vectors(spark, few)) == plain_clusters(few)
    empty = subvector_kmeans.cluster_table(vectors(spark, [(1, None)]))
    assert empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"] and not empty.collect()


@pytest.mark.parametrize("kind", ["repeats", "plain", "constant"])
def test_blocks_lose_nothing(kind):
    r = np.random.default_rng(3)
    data = {"repeats": r.integers(-500, 500, (6, 16))[r.integers(0, 6, 400)], "plain": r.integers(-(10**9), 10**9, (400, 16)), "constant": np.full((400, 16), 7)}[kind]
    blocks = subvector_kmeans._blocks(data)
    back = np.hstack([s[c] for _, s, c in blocks])
    assert (back == data).all() and [b[0] for b in blocks] == list(np.cumsum([0, *[b[1].shape[1] for b in blocks]])[:-1])
    assert len(blocks) == (16 if kind == "plain" else 1)  # repeated vectors are one code each


# ---- language model


def plain_tree(docs, depth, context, follow, gain, discount=0.5):
    """Scores by dictionaries over tuples of words."""
    tokens = {i: [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")), None] for i, (_, t) in enumerate(docs)}
    held = {i: k is not None and zlib.crc32(str(k).encode()) % 7 == 2 for i, (k, _) in enumerate(docs)}
    counts = [collections.Counter() for _ in range(depth + 2)]
    for i, t in tokens.items():
        if not held[i]:
            for k in range(1, depth + 2):
                counts[k].update(tuple(t[a : a + k]) for a in range(len(t) - k + 1))
    n, v = sum(counts[1].values()), len(counts[1])
    p = {g: (c + 1) / (n + v + 1) for g, c in counts[1].items()}
    root, kept, left = p, {}, {}
    for k in range(1, depth + 1):
        by, upper = collections.defaultdict(list), {}
        for g, c in counts[k + 1].items():
            if c >= follow and counts[k][g[:-1]] >= context and counts[k][g[1:]] >= follow and g[1:] in p:
                by[g[:-1]].append((g, c))
        for s, own in by.items():
            whole = counts[k][s]
            beta = 1 - sum(c - discount for _, c in own) / whole
            full = {g: (c - discount) / whole + beta * p[g[1:]] for g, c in own}
            won = sum(c * math.log(full[g] / p[g[1:]]) for g, c in own) + (whole - sum(c for _, c in own)) * math.log(beta)
            if won >= gain:
                left[s] = beta
                kept |= full
            upper |= {g: full[g] if won >= gain else p[g[1:]] for g, _ in own}
        p = upper
    out = []
    for i, t in tokens.items():
        base = score = 0.0
        for a in range(len(t)):
            b = root.get((t[a],), 1 / (n + v + 1))
            q = b
            for k in range(1, min(depth, a) + 1):
                s = tuple(t[a - k : a])
                if s in left:
                    q = kept.get(tuple(t[a - k : a + 1]), left[s] * q)
            base, score = base + math.log10(b), score + math.log10(q)
        out.append((docs[i][0], held[i], len(t), sum(counts[1][(x,)] > 0 for x in t), n, round(base, 6), round(score, 6)))
    return sorted(out, key=repr), left


def lm_docs(n=80):
    r = random.Random(5)
    common = [f"c{k}" for k in range(8)]
    docs = []
    for k in range(n):
        said, last = [], "c0"
        for _ in range(r.randint(0, 120)):
            last = r.choice(common) if r.random() < 0.4 else {"c0": "c3", "c3": "C5", "c5": "c1", "c1": "rare"}.get(last.lower(), f"w{r.randrange(200)}")
            said.append(last)
        docs.append((k, "\t".join(said)))
    return docs + [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "new words only"), (None, "c0 c3 c5"), (3, docs[3][1]), (3, docs[3][1]), (n + 4, "Long" + "y" * 5000 + " c0 c3 c5 c1")]


@pytest.mark.parametrize("size", [10**6, 300])
@pytest.mark.parametrize("depth", [1, 3])
def test_tree_is_plain(spark, depth, size):
    docs = lm_docs()
    options = {"depth": depth, "context": 12, "follow": 3, "gain": 4.0}
    encoded = suffix_tree_lm.encode(table(spark, docs).repartition(2), held=F.crc32(F.col("doc_id").cast("string")) % 7 == 2, size=size)
    out = suffix_tree_lm.score(encoded, suffix_tree_lm.fit(encoded, **options))
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in out.collect()), key=repr)
    expect, states = plain_tree(docs, **options)
    assert got == expect
    assert {len(s) for s in states} >= ({1, 2} if depth > 1 else {1})


def test_levels_are_written_once(spark, monkeypatch):
    """Each level of the tree is one table; what is answered are counts, and neighbouring keys go to one bucket."""
    written, write = [], suffix_tree_lm.materialise
    encoded = suffix_tree_lm.encode(table(spark, lm_docs()).repartition(2))
    monkeypatch.setattr(suffix_tree_lm, "materialise", lambda df, free=False: written.append(df) or write(df, free))
    tree = suffix_tree_lm.fit(encoded, depth=2, context=12, follow=3, gain=4.0)
    assert len(written) == 3 and dict(tree.answers.dtypes)["n"] == "bigint"
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64))
    assert np.array_equal(np.concatenate([at for _, at in suffix_tree_lm._dealt(keys, 7)]), np.arange(5000))
    own = spark.createDataFrame([(int(k),) for k in keys[::100].view(np.int64)], "key long").selectExpr("key", "shiftrightunsigned(shiftrightunsigned(key, 32) * 7L, 32) AS bucket")
    assert {(r.key, r.bucket) for r in own.collect()} == {(int(k), b) for b, at in suffix_tree_lm._dealt(keys[::100], 7) for k in keys[::100][at].view(np.int64)}


@pytest.mark.parametrize("parts", [4, 8])
def test_parts_change_no_score(spark, monkeypatch, parts):
    """Levels and scores are written in parts: a context is counted in one of them, a slice is scored in one, and all rows are there."""
    docs, written, write = lm_docs(), [], suffix_tree_lm.materialise

    def kept(df, free=False):
        df = df if hasattr(df, "columns") else list(df)
        written.append((df, free))
        return write(df, free)

    options = {"depth": 2, "context": 12, "follow": 3, "gain": 4.0}
    encoded = suffix_tree_lm.encode(table(spark, docs).repartition(2), held=F.crc32(F.col("doc_id").cast("string")) % 7 == 2, size=300)
    monkeypatch.setattr(suffix_tree_lm, "materialise", kept)
    out = suffix_tree_lm.score(encoded, suffix_tree_lm.fit(encoded, parts=parts, **options))
    split = [df for df, free in written if isinstance(df, list) and free]
    assert len(split[0]) >= 2 and len(split[-1]) == parts
    contexts = [{r.context for r in df.select("context").collect()} for df in split[0]]
    assert sum(map(bool, contexts)) > 1 and len(set().union(*contexts)) == sum(map(len, contexts))
    assert max(df.count() for df in split[-1]) < len(docs)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in out.collect()), key=repr)
    assert got == plain_tree(docs, **options)[0]


def test_slices_are_short(spark):
    """Codes of frequent words are small, and stand for the same words."""
    r = random.Random(2)
    said = [f"c{int(r.paretovariate(0.9))}" for _ in range(20_000)]
    s = suffix_tree_lm.Slice(suffix_tree_lm.encode(table(spark, [(1, " ".join(said))])).first().asDict())
    n = np.bincount(s.codes[:-1])
    assert (np.diff(np.log2(n).astype(int)) <= 0).all() and len(np.unique(s.words)) == len(n) + 1
    assert list(collections.Counter(s.codes[:-1].tolist()).values()) == list(collections.Counter(said).values())


def test_tree_sums_to_one():
    """What the states of ``plain_tree`` hold is a distribution: the discounted counts and what is left."""
    docs = lm_docs()
    _, left = plain_tree(docs, 2, 12, 3, 4.0)
    assert all(0 < b < 1 for b in left.values())


def test_tree_without_training_rows(spark):
    keys = [k for k in range(60) if zlib.crc32(str(k).encode()) % 7 == 2][:3]
    got = rows(suffix_tree_lm.score_table(table(spark, [(k, "a b") for k in keys])))
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got] == [(3, 0, 0, 0.0, 0.0)] * 3
    assert not suffix_tree_lm.score_table(table(spark, [])).collect()
    only = rows(suffix_tree_lm.score_table(table(spark, [(keys[0], None)])))
    assert only[0]["n_tokens"] == 1 and only[0]["held_out"]


def test_held_out_gains(spark):
    """On texts with an order of words the tree is better than the counts, on rows it has not seen too."""
    docs = lm_docs(400)
    got = rows(suffix_tree_lm.score_table(table(spark, docs), context=16, follow=4))
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.95 * sum(r["base_score"] for r in held)


# ---- pages that are wrapped as a whole, and names inside operators

RICH = "This is a line of the text that has many of the words that are in all texts, and it is as long as it has to be for that."
OTHER = "Длинный абзац без знакомых слов, в нём семьдесят букв и ещё немного."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<body><form id="aspnetForm"><div class=nav>Menu of all</div><div><p>{RICH}</p><p>Short.</p></div></form></body>', f"{RICH}\n\nShort."),
        (f'<form id="f"><article><p>{RICH}</p></article><div class="sidebar">{RICH[:60]}</div></form>', RICH),
        (f"<div hidden><article><p>{RICH}</p></article></div>", RICH),
        (f'<div aria-hidden="true"><article><p>{RICH}</p></article></div>', RICH),
        (f'<div role="form"><article><p>{RICH}</p></article></div><footer>{RICH}</footer>', RICH),
        (f'<div class="widgets"><p>{RICH}</p></div>', RICH),
        ("<p>Hi there.</p>", "Hi there."),
        (f"<p>{OTHER}</p><p>{OTHER}</p>", f"{OTHER}\n\n{OTHER}"),
        (f"<ul><li>Home<li>News<li>About</ul><h1>Title</h1><p>{RICH}</p><ul><li>One</li></ul>", f"Title\n\n{RICH}\n\nOne"),
        (f"<ul><li>Home</li></ul><article><ul><li>First</li></ul><p>{RICH}</p></article>", f"First\n\n{RICH}"),
        (f'<p>{RICH}</p><form>{RICH} {RICH} {RICH}</form><div class="comments">{RICH}</div>', RICH),
        ("<nav>Only a menu</nav><script>x</script>", ""),
    ],
)
def test_wrapped_pages(page, want):
    assert html_text.main_text(page) == want


def test_deep_wrappers_take_linear_time():
    page = "<form>" * 20_000 + f"<p>{RICH}</p>"
    begun = time.time()
    assert html_text.main_text(page) == RICH
    assert time.time() - begun < 5


INNER = "_group _draws _d _epoch _row _doc _hash _id _tokens _copies _order _bucket _inside _start _columns _text_hash _gone __doc __hash doc text_hash _stay _lang _score _block node kind rep label"


@pytest.mark.parametrize("stage", [k for k, _ in corpus_pipeline.STAGES[:-1]])
def test_columns_may_have_any_name(spark, stage):
    """Each stage gives the columns it was given, though they are called what stages use inside."""
    names = INNER.split()
    words = [" ".join(f"w{(k * 7 + j) % 90}" for j in range(60)) for k in range(8)]
    data = [(k, words[k % 6], "en", f"s{k % 2}", 100, *[f"{c}{k}" for c in names]) for k in range(8)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in names))
    out = dict(corpus_pipeline.STAGES)[stage](spark, docs, "")
    assert out.columns == docs.columns
    got = out.collect()
    assert got and all(r[c] == f"{c}{r.doc_id}" for r in got for c in names)


def test_labels_of_missing_documents_take_no_place(spark):
    docs = table(spark, [(k, f"text {k} " + ("bad" if k % 2 else "good")) for k in range(1, 20)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 4000)], "doc_id long, toxic long")
    texts, toxic = toxicity.training_sample(docs, labels, size=4)
    assert len(texts) == 8 and sorted(toxic.tolist()) == [0.0] * 4 + [1.0] * 4
