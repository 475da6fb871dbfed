"""Operators against plain versions of what they compute, on small tables and planted cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
from distlearn.llm import bpe, extract, language_model, mixing, neighbours, passages, secret_scan, simhash, toxicity, vector_dedup
from distlearn.llm.common import fold
from distlearn.plans import components

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


def result(spark, name):
    return entry.queries()[name](spark, SMALL).collect()


# ---------------------------------------------------------------- tokens


@pytest.fixture(scope="module")
def vocabulary():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return bpe.Vocabulary.parse(f.read())


@pytest.fixture(scope="module")
def standard(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def test_bpe_query(spark, texts, standard):
    for r in result(spark, "op9_byte_bpe"):
        ids = np.array(standard.encode_ordinary(texts[r["doc_id"]]), "<u4")
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_bpe_odd_texts(vocabulary, standard):
    draw, encoder = random.Random(1), bpe.Encoder(vocabulary, public_tokenizers.PATTERN)
    for _ in range(3000):
        text = "".join(draw.choice("aeiouthrnsl ing0123 !?é漢\n\t😀   \x1c\x0b'st") for _ in range(draw.randint(0, 60)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == standard.encode_ordinary(text), text


def test_bpe_appends_and_edits(vocabulary, standard):
    draw = random.Random(2)
    for _ in range(500):
        data = bytes(draw.choice(b"aabbtheing  01\xe9\xc3") for _ in range(draw.randint(1, 90)))
        p = bpe.Prefixes(vocabulary, data[:20])
        p.append(data[20:])
        assert p.ids() == standard._core_bpe.encode_single_piece(data)
        a = draw.randint(0, len(data))
        b = draw.randint(a, len(data))
        p.replace(a, b, b"then")
        assert p.ids() == standard._core_bpe.encode_single_piece(data[:a] + b"then" + data[b:])


# ---------------------------------------------------------------- SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def test_simhash_query(spark, texts):
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    ids = sorted(prints)
    values = np.array([prints[i] for i in ids], np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    want = plain_components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))])
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in result(spark, "op4_simhash")}
    assert got == {i: (prints[i], want[i]) for i in ids}


@pytest.mark.parametrize("bucket", [2, 2_048])
def test_simhash_links(spark, bucket, monkeypatch):
    """Dense and sparse groups of fingerprints, with hot variants cut into many pieces."""
    monkeypatch.setattr(components, "CONTRACT_ROWS", 50)
    draw, values = random.Random(3), set()
    for _ in range(12):
        start = draw.getrandbits(64)
        for _ in range(20):
            values.add(start ^ sum(1 << draw.randrange(64) for _ in range(draw.randint(0, 3))))
            start ^= draw.choice([0, 0, 1 << draw.randrange(64)])
    values = sorted(v & (2**64 - 1) for v in values)
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    classes = spark.createDataFrame([(v, 0) for v in signed], "fp long, least long")
    found = simhash.links(classes, bucket=bucket)
    got = plain_components(signed, [(r["u"], r["v"]) for r in found.collect()])
    want = plain_components(signed, [(a, b) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & (2**64 - 1)).count("1") <= 3])
    assert got == want
    assert {r["node"]: r["root"] for r in components.connected_components(found).collect()}.items() <= want.items()


# ---------------------------------------------------------------- vectors


def planted_vectors(spark, seed=4):
    draw = np.random.default_rng(seed)
    rows = []
    for g in range(30):
        centre = draw.standard_normal(16)
        for k in range(int(draw.integers(1, 30))):
            rows.append(centre + draw.uniform(0.02, 0.18) * draw.standard_normal(16) * (k > 2))
    x = np.array(rows, np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    return frame, unit @ unit.T


@pytest.mark.parametrize("bucket", [8, 4_096])
def test_vector_links(spark, bucket, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BUCKET", bucket)
    frame, cosine = planted_vectors(spark)
    near = cosine >= 0.9
    np.fill_diagonal(near, False)
    assert np.abs(cosine - 0.9).min() > 1e-9
    want = plain_components(range(len(near)), zip(*np.nonzero(near)))
    got = {r["vec_id"]: r for r in vector_dedup.near_duplicates(frame).collect()}
    assert {i: r["n_links"] for i, r in got.items()} == {i: int(n) for i, n in enumerate(near.sum(axis=1))}
    assert {i: r["component_id"] for i, r in got.items()} == want


def test_vector_tables_reach_the_recall():
    draw = np.random.default_rng(5)
    k, tables = vector_dedup.table_sizes(100_000)
    a = draw.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = draw.standard_normal((2000, 64))
    side -= (side * a).sum(axis=1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.9 * a + math.sqrt(1 - 0.81) * side
    met = (vector_dedup.bucket_ids(a, k, tables) == vector_dedup.bucket_ids(b, k, tables)).any(axis=1)
    assert met.mean() > 0.99


@pytest.mark.parametrize("block", [16, 16_384])
def test_nearest_in_blocks(spark, block, monkeypatch):
    monkeypatch.setattr(neighbours, "VECTOR_BLOCK", block)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", block)
    frame, cosine = planted_vectors(spark, 6)
    got = defaultdict(list)
    for r in neighbours.nearest(frame, F.col("vec_id") % 5 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["id"], r["score"]))
    for q in range(0, len(cosine), 5):
        others = [i for i in range(len(cosine)) if i != q]
        best = sorted((cosine[q, i] for i in others), reverse=True)[:5]
        assert np.allclose([s for _, s in got[q]], best, atol=1e-12)
        assert all(s1 > s2 or (s1 == s2 and i1 < i2) for (i1, s1), (i2, s2) in zip(got[q], got[q][1:]))


# ---------------------------------------------------------------- secrets


def test_secret_spans(spark):
    text = 'é😀 PassWord: "hunter2x" token=abc; api_key = Zz/9+=._-q AKIA' + "Q" * 16 + " x " + "0123456789abcdef" * 2 + " token:'secret: abcdefgh' ghp_" + "a" * 36
    docs = spark.createDataFrame([(1, text), (2, text * 700)], "doc_id long, text string")
    got = {r["doc_id"]: r["found"] for r in secret_scan.find_secrets(docs).collect()}
    for i, t in ((1, text), (2, text * 700)):
        want = []
        for at, r in enumerate(secret_scan.BASE + secret_scan.FURTHER):
            want += [(m.start(), at, m.end(), r.kind) for m in re.finditer(r.pattern, t) if len(m[r.group]) >= r.least]
        assert [tuple(s) for s in got[i]] == sorted(want)


def test_trigram_queries():
    queries = {r.kind: secret_scan.trigram_query(r.pattern) for r in secret_scan.BASE}
    assert queries["hex"] == [] and {"aki", "kia"} in [set(c) for c in queries["access"][0]]
    assert frozenset(["tok", "oke", "ken"]) in queries["assign"][0] and frozenset(["api", "pik", "ike", "key"]) in queries["assign"][0]


# ---------------------------------------------------------------- mixing


def test_mix_takes_the_plan(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    plan = {r["doc_id"]: r for r in mixing.plan_mix(docs).collect()}
    words = Counter()
    for r in mixing.mix(docs).select("doc_id", "text").collect():
        words[r["doc_id"]] += len((r["text"] or "").encode().split())
    assert words == Counter({i: r["taken"] for i, r in plan.items() if r["taken"] or not r["size"]})
    by_source = defaultdict(int)
    for r in docs.select("doc_id", "source").collect():
        by_source[r["source"], plan[r["doc_id"]]["target"]] += plan[r["doc_id"]]["taken"]
    assert all(abs(n - target) <= 0.5 for (_, target), n in by_source.items())


def test_mix_counts_every_row_for_itself(spark):
    draw = random.Random(9)
    docs = []
    for i in range(300):
        words = " ".join(f"w{draw.randint(0, 99)}" for _ in range(draw.randint(0, 40)))
        docs.append((draw.choice([None, 1, 2, 1000 + i]), draw.choice(["a", "b", "c", None]), draw.choice([words, None, "the same text"]), {"k": i % 3}))
    docs += [(7, "d", "one two three four five", None)] * 40 + [(None, "e", "six seven eight", None)] * 30  # the cut goes through equal rows
    table = spark.createDataFrame(docs, "doc_id long, source string, text string, n map<string,int>").withColumns({c: F.lit("x") for c in ("key", "size", "tie", "rest", "named", "copy", "row")})
    want, taken = defaultdict(int), defaultdict(int)
    plan = mixing.plan_mix(table).collect()
    sizes = {}
    for doc, source, text, _ in docs:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    assert len(plan) == len(docs) and len(set(sizes.values())) == len(sizes)
    of = {n: s for s, n in sizes.items()}
    for r in plan:
        want[of[r["source_size"]]] += r["taken"]
        assert r["taken"] <= 3 * r["size"]
    mixed = mixing.mix(table)
    assert mixed.columns == table.columns
    for r in mixed.collect():
        taken[r["source"]] += len((r["text"] or "").split())
    assert {s: n for s, n in taken.items() if n} == {s: n for s, n in want.items() if n} and any(0 < want[s] % sizes[s] for s in "de")
    targets = {of[r["source_size"]]: r["target"] for r in plan}
    assert all(abs(want[s] - targets[s]) <= 0.5 for s in sizes)


def test_mix_targets(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 10), (None, 1000), ("c", 5)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    # a: capped at 3, b at 30, c at 15; null has weight 1 and the rest
    assert got == {"a": 3.0, "b": 30.0, "c": 15.0, None: 968.0}


# ---------------------------------------------------------------- language model


def test_language_model(spark, texts):
    got = {r["doc_id"]: r for r in result(spark, "op8_language_model")}
    tokens = {i: [*t.encode().lower().split(), None] for i, t in texts.items()}
    counts = Counter()
    for i, words in tokens.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(words)
    total, distinct = sum(counts.values()), len(counts)
    for i, words in tokens.items():
        r = got[i]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words)
        assert r["n_tokens"] == len(words) and r["n_known"] == sum(counts[w] > 0 for w in words) and r["train_tokens"] == total
        assert abs(r["base_score"] - base) < 1e-6
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # better on texts it has not seen


def test_language_model_does_not_depend_on_layout(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(300)
    one = {r["doc_id"]: r for r in language_model.score(docs, fold(5) != 1).collect()}
    for name, value in (("CHUNK_TOKENS", 5_000), ("PART_BYTES", 50_000), ("FREQUENT", 200)):
        monkeypatch.setattr(language_model, name, value)
    two = {r["doc_id"]: r for r in language_model.score(docs.repartition(3, "doc_id"), fold(5) != 1).collect()}
    assert one.keys() == two.keys()
    for i, r in one.items():
        assert abs(r["score"] - two[i]["score"]) < 1e-6 and r["n_known"] == two[i]["n_known"]


def test_language_model_counts_the_word_before(spark, texts):
    """The interpolated score by brute force: c(h) and c(h, w) of the word before itself, not of a class of words."""
    from pyspark.sql import functions as F

    got = {r["doc_id"]: r["score"] for r in result(spark, "op8_language_model")}
    ids = spark.createDataFrame([(i,) for i in texts], "doc_id long")
    held_back = {r[0] for r in ids.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(language_model.HELD_BACK)) == 0).collect()}
    tokens = {i: [*t.encode().lower().split(), None] for i, t in texts.items()}
    training = [i for i in texts if zlib.crc32(str(i).encode()) % 5 != 1]

    def counts(docs):
        words, pairs = Counter(), Counter()
        for i in docs:
            words.update(tokens[i])
            pairs.update(zip([None, *tokens[i][:-1]], tokens[i]))
        return words, pairs, sum(words.values())

    words, pairs, total = counts(i for i in training if i not in held_back)
    found = Counter()
    step = lambda p: round(math.log10(p) / language_model.STEP) if p else None
    for i in training:
        if i in held_back:
            for h, w in zip([None, *tokens[i][:-1]], tokens[i]):
                found[math.ceil(math.log2(words[h] + 1)), step(pairs[h, w] / words[h] if words[h] else 0), step(words[w] / total)] += 1
    words, pairs, total = counts(training)
    assert len(words) > 10_000
    weights = language_model.learn_weights([(*k, n) for k, n in found.items()], len(words))
    for i, own in tokens.items():
        score = 0.0
        for h, w in zip([None, *own[:-1]], own):
            a, b, c = weights[math.ceil(math.log2(words[h] + 1))]
            score += math.log10((a * pairs[h, w] / words[h] if words[h] else 0) + b * words[w] / total + c / (len(words) + 1))
        assert abs(got[i] - score) < 1e-6 * max(1, len(own))


def test_weights_by_expectation_maximisation():
    rows = [(3, -50, -100, 1000), (3, None, -100, 500), (5, -10, -150, 1000)]
    w = language_model.learn_weights(rows, 1000)
    assert np.allclose(w.sum(axis=1), 1) and w[5, 0] > 0.99 and 0.3 < w[3, 0] < 0.9 and w[0, 0] == 0


# ---------------------------------------------------------------- passages


def test_repeated_passages(spark):
    draw = random.Random(7)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(3))
    shared = [[word() for _ in range(n)] for n in (49, 50, 51, 80, 200)]
    docs = []
    for i in range(150):
        words = [word() for _ in range(draw.randint(0, 60))]
        for _ in range(draw.randint(0, 3)):
            p = draw.choice(shared)
            a = draw.randint(0, len(p) - 1)
            words += p[a : a + draw.randint(1, 200)] + [word() for _ in range(draw.randint(0, 30))]
        docs.append((i, " ".join(words)))
    split = {i: t.split() for i, t in docs}
    first = {}
    for i, words in split.items():
        for a in range(len(words) - 49):
            first.setdefault(tuple(words[a : a + 50]), i)
    got = {r["doc_id"]: r for r in passages.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    removed = 0
    for i, words in split.items():
        gone = {a + k for a in range(len(words) - 49) if first[tuple(words[a : a + 50])] < i for k in range(50)}
        assert got[i]["kept"] == " ".join(w for a, w in enumerate(words) if a not in gone) and got[i]["n_removed"] == len(gone)
        removed += len(gone)
    assert removed > 1000


# ---------------------------------------------------------------- pages


PAGE = """<!DOCTYPE html><html><head><title>Title</title><style>p{}</style></head><body class="page">
<header><a href="/">Site name</a></header><nav><ul><li><a>Home</a></li></ul></nav>
<div id="cookie-notice"><p>We use cookies, please accept all of them now.</p></div>
<%s><h1>The   heading</h1><p>First <b>bold</b>er &amp; <i>best</i>.<br>Line&nbsp;two</p><!-- <p>no</p> -->
<aside>Related things to read</aside><div class="ad-banner"><p>Buy now</p></div><p>Last words of it</p>
<form><label>Mail</label><input><button>Go</button></form></%s>
<section class="comments"><p>I disagree with all of this, said the reader at length.</p></section>
<footer><p>All rights reserved by the owner of this page</p></footer><script>var t="</p>";</script></body></html>"""


def test_main_text():
    counts = {}
    inside, outside = Counter(), Counter()
    extract.count_kinds(PAGE % ("article", "article"), inside, outside)
    for k in inside | outside:
        counts[k] = (inside[k], outside[k])
    weights = extract.learned(counts)
    assert all(w > 0 for k, w in weights.items() if k.startswith(extract.WORD)) and all(w < 0 for k, w in weights.items() if k.startswith(extract.TAG))
    want = "The heading First bolder & best. Line two Last words of it"
    for tag in ("article", "main", "div"):
        assert extract.main_text(PAGE % (tag, tag), weights) == want, tag


LONG = 1_000_000
ARTICLE = "<h1>Head</h1><p>one two three four five six</p><p>seven eight nine ten</p>"
ODD_PAGES = {
    "a long attribute": '<nav data-x="' + "y" * LONG + f'">menu here</nav>{ARTICLE}',
    "ends of tags in values": f'<nav data-x="a > b">menu</nav><p data-y=\'c > d\'></p>{ARTICLE}',
    "a stray quote": f'<p title="5" disk">{ARTICLE}',
    "a word in another attribute": f'<div data-id="ads" title="class=sidebar hidden">{ARTICLE}</div>',
    "a layout with a sidebar": f'<body><nav>menu</nav><div class="layout has-sidebar">{ARTICLE}</div><footer>foot</footer></body>',
    "no comments": f'<div class="content no-comments">{ARTICLE}</div>',
    "a result of a search": f'<nav>menu</nav><div id="article-search-result">{ARTICLE}</div><div class="comments"><p>I see</p></div>',
    "a form around all": f'<form id="all"><div class="ad">Buy</div>{ARTICLE}</form>',
    "long comments": ARTICLE + '<div class="comments">' + "<p>no I do not agree</p>" * 50 + "</div>",
    "many wrappers": '<div class="sidebar">' * 200 + ARTICLE,
}


@pytest.mark.parametrize("name", ODD_PAGES)
def test_main_text_of_odd_pages(name):
    assert extract.main_text(ODD_PAGES[name], {}) == "Head one two three four five six seven eight nine ten"


@pytest.mark.parametrize("part", ['<a "> " ', '<a x="> " ', "<a ", '<a x="', "<script ", "<!--", "<p x='", '<div class="ad">', "= ", "</ ", "<? ", "<!", "&", "<a b>", "<form>"])
def test_main_text_takes_linear_time(part):
    import time

    started = time.process_time()
    for page in (part * (LONG // 4 // len(part)), "<a " + part * (LONG // 4 // len(part))):
        extract.main_text(page, {})
    assert time.process_time() - started < 20


def test_text_of_unended_tags():
    assert extract.main_text("five <b and six", {}) == "five <b and six"
    assert extract.main_text('<p>a</p><p title="5>b is c</p>', {}) == "a b is c"
    assert extract.main_text("<p>a <!-- b", {}) == "a"
    assert extract.main_text("<p>3 < 4 > 2 </3", {}) == "3 < 4 > 2 </3"


def test_best_stretch():
    draw = random.Random(8)
    for _ in range(300):
        scores = [draw.randint(-5, 5) for _ in range(draw.randint(0, 12))]
        a, b = extract.best_stretch(scores)
        assert sum(scores[a:b]) == max([0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1))])


def test_main_text_query(spark):
    import html

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    for r in result(spark, "op2_main_text"):
        inner = re.sub(r"</?b>", "", re.search(r"(?s)<article>(.*)</article>", pages[r["page_id"]])[1])
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", inner)).split())
        assert r["text"] == want and r["n_chars"] == len(want)


# ---------------------------------------------------------------- toxicity


def test_toxicity(spark, texts):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in result(spark, "op5_toxicity")}
    assert got.keys() == texts.keys()
    held = [(got[i], y) for i, y in labels.items() if got[i]["held_out"]]
    right = sum(r["predicted"] == y for r, y in held) / len(held)
    assert right > 0.9
    flagged = [y for r, y in held if r["predicted"]]
    assert flagged and sum(flagged) / len(flagged) > 0.9


def test_toxicity_tolerates_gaps(spark):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = toxicity.train(docs, labels, fold(4) != 2)
    reader = toxicity.Reader(toxicity.Kernel(model.landmarks))
    clean, *bad = model.scores(reader, ["the thing of the other", "the idiot of it", "the i-d-i-o-t of it", "you i d i o t there", "an id.iot!", "a st*upid thing", "what a stxupid one", "WORTHL3SS"])
    assert clean < 0.1 and min(bad) >= 0.3
