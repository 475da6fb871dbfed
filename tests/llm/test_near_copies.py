"""The pipeline's near copies, against all pairs; rows with null and shared ids."""

import random

import numpy as np
import pytest

import corpus_pipeline
from distlearn.llm import near_copies, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def kept(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], SCHEMA)
    return sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()), key=repr)


def prose(draw, n):
    return [f"w{draw.randrange(5000)}" for _ in range(n)]


def altered(draw, words, changes):
    words = list(words)
    for at in draw.sample(range(len(words)), changes):
        words[at] = f"x{draw.randrange(5000)}"
    return words


@pytest.mark.parametrize("bucket", [3, near_copies.BUCKET])
def test_all_pairs(spark, bucket, monkeypatch):
    monkeypatch.setattr(near_copies.loose_groups, "__defaults__", (near_copies.SIMILARITY, bucket))
    monkeypatch.setattr(near_copies.verified, "__defaults__", (near_copies.SIMILARITY, bucket))
    draw, texts = random.Random(5), []
    for n in (60, 100, 100, 300, 300):
        start = prose(draw, n)
        texts += [start] + [altered(draw, start, max(1, round(n * share))) for share in (0.01, 0.02, 0.03, 0.06, 0.2)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [near_copies.shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if near_copies.similarity(sets[a], sets[b]) >= 0.8 and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    assert 5 < len(set(root)) < len(rows)
    assert [i for i, _ in kept(spark, rows)] == sorted(set(root), key=lambda i: repr((i, rows[i][1])))


def test_simhash_refuses_more_bits(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1, 0)], "fp long, least long"), near=4)


def test_null_and_shared_ids(spark):
    draw = random.Random(6)
    a, b, c, d = (prose(draw, 100) for _ in range(4))
    rows = [(None, a), (None, b), (7, c), (7, d), (3, altered(draw, d, 1)), (None, altered(draw, a, 1)), (None, b)]
    rows = [(i, " ".join(t)) for i, t in rows]
    found = kept(spark, rows)
    assert len(found) == 4 and rows[1] in found and rows[2] in found and rows[4] in found
    assert len({rows[0], rows[5]} & set(found)) == 1


def test_rerun_keeps_the_same_row(spark):
    rows = [(1, "a text of some words here", lang, "s", None) for lang in "abcdefgh"]
    runs = [corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(r, SCHEMA).coalesce(1), "").collect() for r in (rows, rows[::-1])]
    assert len(runs[0]) == 1 and runs[0] == runs[1]


def test_links_of_many_near_copies_grow_with_their_number(spark):
    """Copies 0.7 to 0.9 alike: at most two links a text, and the components of all pairs."""
    draw = random.Random(7)
    start = prose(draw, 120)
    texts = [" ".join(altered(draw, start, draw.randint(0, 4))) for _ in range(600)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    marked = near_copies.signatures(docs).withColumnRenamed("doc_id", "first")
    groups = near_copies.loose_groups(marked, bucket=100)
    assert groups.count() > 400
    asked = near_copies._shingled(docs.select(near_copies.text_class().alias("class"), "text")).join(marked.select("class", "signature"), "class").join(groups, "class")
    links = near_copies.verified(asked.dropDuplicates(["class"]), limit=100).collect()
    assert len(links) <= 2 * 600
    root = {r["class"]: r["class"] for r in groups.collect()}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {r["class"]: near_copies.shingles(r["text"]) for r in docs.select(near_copies.text_class().alias("class"), "text").collect()}
    for r in links:
        assert near_copies.similarity(sets[r["u"]], sets[r["v"]]) >= 0.8
        root[top(r["u"])] = top(r["v"])
    names = list(root)
    for i, a in enumerate(names):
        for b in names[:i]:
            if top(a) != top(b):
                assert near_copies.similarity(sets[a], sets[b]) < 0.8


def test_clashing_names_and_maps(spark):
    docs = spark.createDataFrame([(1, "one text", {"a": 1}, 5), (2, "one text", {"b": 2}, 6), (3, "another", None, 7)], "doc_id long, text string, kept map<string,int>, class long")
    got = near_copies.drop_near_copies(docs)
    assert got.columns == docs.columns and sorted((r["doc_id"], r["class"]) for r in got.collect()) == [(1, 5), (3, 7)]


def test_fingerprints_are_simhash():
    """Bits differ in the share angle / pi, also in texts of few shingles; equal texts have equal fingerprints."""
    draw = np.random.default_rng(3)
    for size, common in ((5, 4), (9, 8), (100, 90), (1000, 890), (400, 0)):
        share = []
        for _ in range(40):
            h = draw.integers(0, 2**63, 2 * size - common, np.uint64)
            share.append(near_copies.equal_bits(near_copies.signature(h[:size]), near_copies.signature(h[size - common :])[None])[0])
        assert abs(np.mean(share) - (1 - np.arccos(common / size) / np.pi)) < 0.02
    assert near_copies.signature(h).dtype == np.uint64 and near_copies.signature(h).size * 64 == near_copies.BITS


@pytest.mark.parametrize("words, changed", [(49, 24), (9, 8)])
def test_pairs_at_the_threshold_meet(spark, words, changed):
    """Texts with 40 of 50 shingles in common (0.8), and with four of five in a text and its beginning: few loose pairs are missed."""
    draw, rows = random.Random(11), []
    for i in range(500):
        start = [f"w{i}x{draw.randrange(5000)}" for _ in range(words)]
        rows += [(2 * i, " ".join(start)), (2 * i + 1, " ".join(start[:changed] + (["other"] + start[changed + 1 :] if words > 9 else [])))]
    sets = [near_copies.shingles(t) for _, t in rows]
    assert all(near_copies.similarity(sets[2 * i], sets[2 * i + 1]) >= 0.8 for i in range(500))
    marked = near_copies.signatures(spark.createDataFrame(rows, "doc_id long, text string"))
    groups = near_copies.loose_groups(marked)
    assert "bands" not in marked.columns and groups.count() >= 2 * 496
    assert len(kept(spark, rows)) <= 504


def test_segments_follow_the_number_of_texts():
    for texts in (100, 10_000, 1_000_000):
        places = near_copies.segments(texts)
        assert 2 ** places.shape[1] > 16 * texts
        assert near_copies.chance_of_missing(places.shape[1], len(places), near_copies.DIFFER) <= near_copies.MISS


def test_many_pieces_of_a_segment_meet(spark, monkeypatch):
    """Segments cut into ranges find the same groups."""
    draw = random.Random(12)
    texts = [t for _ in range(60) for start in [prose(draw, 80)] for t in (start, altered(draw, start, 1))]
    marked = near_copies.signatures(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))
    groups = []
    for part in (near_copies.PART, 7):
        monkeypatch.setattr(near_copies, "PART", part)
        together = {}
        for r in near_copies.loose_groups(marked).collect():
            together.setdefault(r["group"], set()).add(r["class"])
        groups.append(sorted(map(sorted, together.values())))
    assert groups[0] == groups[1] and len(groups[0]) >= 59


def test_near_copies_in_one_group_travel_once(spark):
    """Of a large group in one component only the strangers meet all pieces; no row is made for each two pieces."""
    rows = [(0, 5, i, 1) for i in range(1000)] + [(0, 5, 1000 + i, 1000 + i) for i in range(3)]
    members = spark.createDataFrame(rows, "part int, key long, id long, root long")
    assert near_copies.across_components(members, 10).count() == 1003 + 3 * 101
    assert near_copies.inside_pieces(members, 10).count() == 1003


def test_a_component_is_dealt_once_for_all_segments(spark):
    """Three texts ask for a component of 100: its texts have one row each, those that ask one for each piece."""
    texts = spark.createDataFrame([(i, 0) for i in range(100)] + [(i, i) for i in range(100, 103)], "id long, root long")
    asks = spark.createDataFrame([(i, i, 0) for i in range(100, 103)], "id long, root long, asked long")
    assert near_copies.asked_components(texts, asks, 10).count() == 100 + 3 * 10
    groups, roots = np.array([5, 5, 5, 7, 7, 7, 7]), np.array([2, 1, 2, 4, 3, 3, 3])
    assert near_copies.largest_roots(groups, roots).tolist() == [2, 2, 2, 3, 3, 3, 3]
