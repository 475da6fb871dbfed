"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from distlearn.llm import bpe, extract, language_model, mixing, neighbours, passages, secret_scan, simhash, toxicity, vector_dedup
from distlearn.llm.common import fold

LONG = "one two three four five " * 30_000
NAMES = "found toxicity n_tokens ids size copy held row kinds spans part phrase least role bucket id v n _doc _source rep component_id".split()
DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(n, T.StringType()) for n in NAMES]
)
TEXTS = [
    (1, "a plain text of several words that says nothing", "s"), (2, "", "s"), (3, None, "s"), (4, "  \t\n ", None), (5, LONG, "t"), (6, LONG, "t"),
    (7, "w" * 200_000, None), (8, "token = abcdef0123456789abcdef0123456789", "s"), (8, "token = abcdef0123456789abcdef0123456789", "s"),
    (9, "naïve Ünïcode — 漢字 😀 text here", ""), (None, "a row without an id", "u"), (None, None, None), (10, "a", "s"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, s, None, *["x"] * len(NAMES)) for i, t, s in TEXTS]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (8, 1), (9, None), (None, 1), (5, 0), (5, 0)], "doc_id long, toxic int")


def bpe_of(docs):
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


RUNS = {
    "secrets": secret_scan.find_secrets,
    "redact": secret_scan.redact,
    "simhash": simhash.near_duplicates,
    "mix_plan": mixing.plan_mix,
    "language_model": lambda d: language_model.score(d, fold(5) != 1),
    "bpe": bpe_of,
    "repeats": passages.remove_repeats,
}


@pytest.mark.parametrize("name", RUNS)
def test_texts(docs, name):
    assert RUNS[name](docs).count() == len(TEXTS)


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(docs, name):
    assert RUNS[name](docs.limit(0)).count() == 0


def test_mix_and_toxicity_keep_columns(docs, labels):
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(docs.limit(0)).count() == 0
    model = toxicity.train(docs, labels, fold(4) != 2)
    scored = toxicity.score(docs, model)
    assert sorted(scored.columns) == sorted(docs.columns)
    assert scored.count() == len(TEXTS) and scored.where("toxicity between 0 and 1").count() == len(TEXTS)
    blank = toxicity.train(docs, labels.limit(0), fold(4) != 2)
    assert toxicity.score(docs, blank).select("toxicity").distinct().count() == 1
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_values(docs):
    found = {r["doc_id"]: r for r in secret_scan.digest(secret_scan.find_secrets(docs)).collect()}
    assert (found[8]["n_assign"], found[8]["n_hex"]) == (1, 1) and found[8]["spans"] == "assign:0:40,hex:8:40"
    assert {r["text"] for r in secret_scan.redact(docs).where("doc_id = 8").collect()} == {"[SECRET]"}
    assert secret_scan.redact(docs).where("doc_id = 3").head()["text"] is None
    groups = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).where("doc_id is not null").collect()}
    assert groups[6] == 5 and groups[4] == groups[3] == groups[2] == 2 and groups[8] == 8
    gone = {r["doc_id"]: r for r in passages.remove_repeats(docs).collect()}
    assert gone[6]["n_removed"] == 150_000 and gone[5]["n_removed"] == 0 and gone[6]["kept"] == ""
    scored = {r["doc_id"]: r for r in language_model.score(docs, fold(5) != 1).collect()}
    assert scored[3]["n_tokens"] == 1 and scored[5]["n_tokens"] == 150_001
    decoded = {r["doc_id"]: bytes(r["decoded"]).decode() for r in bpe_of(docs).collect()}
    assert decoded == {i: t or "" for i, t, _ in TEXTS}


def test_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (51, [2.0, 0.0]), (52, [0.0, 1.0]), (53, None), (54, [0.0, 0.0]), (55, [nan, 1.0]), (56, [inf, 1.0]), (57, [None, 1.0]), (58, []), (59, [1.0]), (50, [1.0, 0.0])]
    schema = "vec_id long, embedding array<float>"
    vectors = spark.createDataFrame(rows, schema).withColumns({c: F.lit("x") for c in ("id", "v", "n", "rep", "score", "rank", "d", "q")})
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in neighbours.nearest(vectors, F.col("vec_id") % 50 == 0).collect()}
    assert got == {(0, 1): (50, 1.0), (0, 2): (51, 1.0), (0, 3): (52, 0.0), (50, 1): (0, 1.0), (50, 2): (51, 1.0), (50, 3): (52, 0.0)}
    links = sorted(tuple(r) for r in vector_dedup.near_duplicates(vectors).collect())
    assert links[0] == (0, 3, 0, True) and links[1] == links[2] == (50, 3, 0, False) and links[3] == (51, 3, 0, False)
    assert [r[1:] for r in links[4:]] == [(0, i, True) for i in range(52, 60)]
    assert neighbours.nearest(vectors.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert vector_dedup.near_duplicates(vectors.limit(0)).count() == 0


def test_pages(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<p>one &amp; two<br>three</p><nav>menu</nav>", "x"), (3, "u", "<script>" + "x" * 200_000, "x"), (4, "u", "word " * 100_000, "x"), (4, "u", "<p>tie", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [tuple(r) for r in extract.extract(pages).collect()]
    assert len(got) == 6 and (None, "u", "one & two three", 15) in got and (1, "u", "", 0) in got and (3, "u", "", 0) in got and (4, "u", "tie", 3) in got
    assert extract.extract(pages.limit(0)).count() == 0


def test_stages_keep_the_columns(spark, docs, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, str(tmp_path))
            assert out.columns == docs.columns, name
            out.count()
        assert corpus_pipeline.to_tokens(spark, table, str(tmp_path)).count() == table.count()


def test_repeated_rows_keep_their_spans_once(spark):
    text = " ".join(f"w{i}" for i in range(300))
    spans = {}
    for n in (1, 40):
        rows = spark.createDataFrame([(1, text), *[(2, "before " + text)] * n], "doc_id long, text string")
        spans[n] = [len(r["spans"]) for r in passages.covered(rows).collect()]
        got = [tuple(r) for r in passages.remove_repeats(rows).select("doc_id", "n_removed", "kept").collect()]
        assert sorted(got) == [(1, 0, text), *[(2, 300, "before")] * n]
    assert spans[1] == spans[40]
