"""Token counts, the conversation trie and spelling variants against plain versions, on whole tables and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from distlearn.llm import conversation_trie, spellings, token_counts

SMALL = "/root/testdata/sf0.01"
WORDS = public_tokenizers.path("word_bpe_49k.json")


# ---------------------------------------------------------------- token counts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def compiled():
    with open(WORDS, encoding="utf-8") as f:
        return token_counts.Transducer(f.read())


def drawn(draw, i):
    if i % 3 == 0:
        return "".join(draw.choice("aeiouthrnslwd ing0123 !?é漢\n\t😀   \x1c\x0b'strvlmẞİΣß́̈ﬁ한글ǅ²½ⅷ") for _ in range(draw.randint(0, 60)))
    if i % 3 == 1:
        parts = ["the", "ing", "tion", "www", "'", "'re", "'s", " ", "<|endoftext|>", "er", "<|start", "abab", "123", "!!!", "é", "__", "="]
        return "".join(draw.choice(parts) for _ in range(draw.randint(0, 20)))
    return "".join(chr(draw.choice([draw.randint(0, 0x2FF), draw.randint(0x380, 0xD7FF), draw.randint(0x10000, 0x1FFFF)])) for _ in range(20))


def test_counts_of_odd_texts(compiled, library):
    draw = random.Random(1)
    for i in range(6000):
        text = drawn(draw, i)
        assert compiled.count(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_state_maps_compose(compiled, library):
    draw = random.Random(2)
    for i in range(0, 6000, 3):
        text, step = drawn(draw, i), draw.randint(1, 7)
        maps = [compiled.state_map(text[at : at + step]) for at in range(0, len(text), step)]
        cut = draw.randint(0, len(maps))
        for found in (maps, [compiled.compose(maps[:cut]), compiled.compose(maps[cut:])]):  # in one go, and as a tree
            head, total, tail, _ = compiled.compose(found)
            assert compiled.count(head) + total + compiled.count(tail) == len(library.encode(text, add_special_tokens=False).ids), text


def test_a_full_table_starts_anew(library, monkeypatch):
    monkeypatch.setattr(token_counts, "STATES", 20)
    with open(WORDS, encoding="utf-8") as f:
        small = token_counts.Transducer(f.read())
    text = "It's a wonderful, unbelievable day; they'll be here at 12:30 o'clock! " * 3
    assert small.count(text) == len(library.encode(text, add_special_tokens=False).ids)
    assert len(small.table) <= 25


def test_token_query(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = entry.queries()["op11_token_counts"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(texts[r["doc_id"]].encode()), n > 2048)


def test_token_counts_of_cut_texts_and_odd_rows(spark, library):
    long = "The quick brown fox's 12 friends don't jump. " * 400
    texts = [long, long, long, "w" * 5000, "漢字かな" * 700, None, "", "short one", "short one", long + "<|endoftext|>" + long]
    rows = [(i if i else None, t, {"a": i}, "x", "x", "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra map<string,int>, sha string, kept string, n_tokens string")
    got = token_counts.count_tokens(docs, WORDS, chunk_chars=100)
    assert got.columns == ["doc_id", "extra", "sha", "kept", "n_bytes", "n_tokens"]
    want = sorted((i or -1, {"a": i}, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(texts))
    assert sorted((r["doc_id"] or -1, r["extra"], r["n_bytes"], r["n_tokens"]) for r in got.collect()) == want
    assert token_counts.count_tokens(docs.limit(0), WORDS).count() == 0


# ---------------------------------------------------------------- conversations


def plain_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + v[h:]
    members, kids, leaves, saved = defaultdict(list), defaultdict(set), {}, {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members[tuple(v[:d])].append(c)
    for k in members:
        if k:
            kids[k[:-1]].add(k)
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[c] for c in kids[k]) if kids[k] else 1
        saved[k] = (len(members[k]) - 1) * (len(k[-1][1].encode()) if k else 0) + sum(saved[c] for c in kids[k])
    out = []
    for k, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(k))
        parent = min(members[k[:-1]]) if k else None
        out.append((min(m), len(k), parent, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda x: x[:2])


def trie_rows(found):
    return sorted((tuple(r) for r in found.select(*conversation_trie.RESULT).collect()), key=lambda x: x[:2])


def planted_conversations():
    draw = random.Random(3)
    rows = [(c, t, draw.choice("ua"), draw.choice(["x", "y", "zz", "é"])) for c in range(200) for t in range(draw.randint(1, 6))]
    rows += [(c, t, "u", f"same{t}") for c in range(1000, 1150) for t in range(10)]  # one large group of copies
    rows += [(c, t, "u", "same0" if t == 0 else f"{c}-{t}") for c in range(3000, 3060) for t in range(9)]  # one very common first turn
    rows += [(c, t, None, "q" * c) for c in range(2000, 2020) for t in (None, 1)]
    return rows


@pytest.mark.parametrize("limit", [20_000, 100, 3])
def test_trie_of_planted_conversations(spark, limit):
    rows = planted_conversations()
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("first", "seq", "n", "key", "path")})
    assert trie_rows(conversation_trie.prefix_trie(table, limit)) == plain_trie(rows)


def test_trie_query_and_edges(spark):
    table = spark.read.parquet(f"{SMALL}/conversations.parquet")
    assert trie_rows(entry.queries()["op12_prefix_trie"](spark, SMALL)) == plain_trie([tuple(r) for r in table.collect()])
    assert conversation_trie.prefix_trie(table.limit(0)).count() == 0
    twice = [(5, 0, "u", "a"), (5, 0, "u", "a"), (None, 0, "u", "lost"), (6, 3, "u", "z" * 300_000)]
    found = trie_rows(conversation_trie.prefix_trie(spark.createDataFrame(twice, table.schema)))
    assert found == plain_trie([r for r in twice if r[0] is not None])


def test_double_array_holds_every_sequence_and_no_other():
    draw = random.Random(4)
    for _ in range(50):
        seqs = sorted({tuple(draw.randint(0, 6) for _ in range(draw.randint(0, 6))) for _ in range(60)})
        trie = conversation_trie.DoubleArray(np.array([t for s in seqs for t in s], np.int64), np.array([len(s) for s in seqs]))
        prefixes = {s[:d] for s in seqs for d in range(1, len(s) + 1)}
        assert (trie.check[1 : trie.used] >= 0).sum() == len(prefixes)
        reached = {(seqs[s][: d + 1], int(at)) for d, (going, to, _) in enumerate(trie.walk()) for s, at in zip(going, to)}
        assert len(reached) == len(prefixes) == len({at for _, at in reached})


# ---------------------------------------------------------------- spelling variants


def plain_spellings(rows):
    lower, counts = str.maketrans(spellings.UPPER, spellings.LOWER), Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(lower)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}
    near, cuts = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            cuts[k, w[:k] + w[k + 1 :]].add(w)
    for (_, rest), group in cuts.items():
        for w in group:
            near[w] |= group - {w}
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 10 * words[w]:
            form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, words[w], len(near[w]), words.get(form.get(w))))
    return sorted(out)


def spelling_rows(found):
    return sorted(tuple(r) for r in found.select("word", "form", "root", "n", "n_near", "form_n").collect())


@pytest.mark.parametrize("limit", [2048, 20])
def test_spellings_of_planted_words(spark, limit):
    draw, rows = random.Random(5), []
    for i in range(120):
        words = ["".join(draw.choice("abÀ") for _ in range(draw.randint(6, 10))) for _ in range(60)]
        rows.append((i or None, " ".join(w for w in words for _ in range(draw.choice([1, 1, 1, 40])))))
    rows += [(i, "w" * 3000 + " " + "w" * 3001) for i in (500, 501)] + [(502, None), (503, ""), (504, "Twice twice"), (504, "Twice twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("word", "n", "m", "lo", "block", "run")})
    want = plain_spellings(rows)
    assert spelling_rows(spellings.group_spellings(docs, limit)) == want
    assert sum(r[1] is not None for r in want) > 50
    assert spellings.group_spellings(docs.limit(0)).count() == 0


def test_near_pairs_against_all_pairs():
    def one_apart(x, y):
        if len(x) == len(y):
            return sum(a != b for a, b in zip(x, y)) == 1
        x, y = sorted((x, y), key=len)
        return len(y) - len(x) == 1 and any(y[:k] + y[k + 1 :] == x for k in range(len(y)))

    draw = random.Random(6)
    for _ in range(30):
        words = sorted({"".join(draw.choice("aab") for _ in range(draw.randint(1, 9))) for _ in range(150)})
        got = set(zip(*map(np.ndarray.tolist, spellings.near_pairs(words))))
        assert got == {(i, j) for i, x in enumerate(words) for j, y in enumerate(words) if one_apart(x, y)}


def test_spelling_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert spelling_rows(entry.queries()["op13_spelling_variants"](spark, SMALL)) == plain_spellings([(r["doc_id"], r["text"]) for r in docs.collect()])
