"""Token counts, hashed counts and tf-idf, as long tables or as vectors."""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizer as SparkCounts
from pyspark.ml.feature import HashingTF, IDF, NGram
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..base import Fitted, Learner
from ..plans.lineage import settle
from ..plans.order import dense_index
from ..plans.skew import hot_join

ALL_WORDS = (1 << 31) - 1  # Spark's largest vocabulary
DRIVER_CHARACTERS = 2_000_000_000  # of text whose words the driver may hold; those of more are a table
TOKEN = r"[\p{L}\p{N}_]{2,}"  # words of two or more letters, digits or underscores


def tokens(text: Column, lowercase: bool = True, pattern: str = TOKEN) -> Column:
    return F.regexp_extract_all(F.lower(text) if lowercase else text, F.lit(pattern), F.lit(0))


def token_counts(df: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """(id, token, n).

    Words are counted where they are read; only counts are shuffled, by (id, token), so an id that
    many rows share is no hot key.
    """
    words = df.select(id_col, F.explode(tokens(F.col(text_col), **options)).alias("token"))
    return words.groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("n"))


def document_frequencies(counts: DataFrame) -> DataFrame:
    """(token, df) from the long count table."""
    return counts.groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def tf_idf(df: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """(id, token, tf, df, tf_idf) with idf = ln((N + 1) / (df + 1)).

    Words found in a large share of the documents are salted in the join.
    """
    counts = settle(token_counts(df, id_col, text_col, **options).withColumnRenamed("n", "tf"), "counts")
    n = df.count()
    right = document_frequencies(counts).withColumn("_n", F.col("df"))
    joined = hot_join(counts, right, "token", "_n", F.xxhash64(id_col), total=counts.count())
    idf = F.log((F.lit(float(n)) + 1.0) / (F.col("df") + 1.0))
    return joined.select(id_col, "token", "tf", "df", (F.col("tf") * idf).alias("tf_idf"))


class _TextLearner(Learner):
    HYPER = {"text_col": "text", "output_col": "features", "lowercase": True, "pattern": TOKEN, "ngram": 1}
    VERBS = frozenset({"fit", "transform", "fit_transform"})

    def _rows(self, df: DataFrame, supervised: bool) -> DataFrame:
        if self.setting("text_col") not in df.columns:
            raise ValueError(f"text column {self.setting('text_col')!r} not found; have {df.columns}")
        return df


def _words(df: DataFrame, stage) -> DataFrame:
    text = F.coalesce(F.col(stage.setting("text_col")), F.lit(""))
    out = df.withColumn("_words", tokens(text, stage.setting("lowercase"), stage.setting("pattern")))
    if stage.setting("ngram") > 1:
        out = NGram(n=stage.setting("ngram"), inputCol="_words", outputCol="_grams").transform(out)
        out = out.drop("_words").withColumnRenamed("_grams", "_words")
    return out


def word_table(words: DataFrame, min_df: float, rows: int, size: int) -> DataFrame:
    """(token, index, df): the vocabulary of column _words as a table, most frequent words first, ties by the word."""
    entry = lambda n, df: lambda w: F.struct(w.alias("token"), F.lit(n).alias("n"), F.lit(df).alias("df"))
    each = F.concat(F.transform("_words", entry(1, 0)), F.transform(F.array_distinct("_words"), entry(0, 1)))
    counted = words.select(F.explode(each).alias("e")).groupBy("e.token").agg(F.sum("e.n").alias("n"), F.sum("e.df").alias("df"))
    counted = counted.where(F.col("df") >= (min_df if min_df >= 1 else min_df * rows))
    ranked = dense_index(counted.select("token", "df", F.struct(-F.col("n"), "token").alias("place")), "place", "index")
    return settle(ranked.where(F.col("index") < size).select("token", F.col("index").cast("int").alias("index"), "df"), "vocabulary")


def _text_keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("_a"), F.xxhash64(F.lit(1), text).alias("_b")]


def joined_vectors(df: DataFrame, words: DataFrame, vocabulary: DataFrame, text: Column, target: str, rows: int | None) -> DataFrame:
    """``df`` with sparse vectors by joins with the vocabulary; ``rows`` is that of the fit for weights by ln((N + 1) / (df + 1)), or None.

    Rows are known by two hashes of their text, as equal texts have equal vectors.
    """
    size = vocabulary.count()
    keyed = words.select(*_text_keys(text), "_words")
    copies = settle(keyed.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_copies")), "copies")
    counts = settle(keyed.select("_a", "_b", F.explode("_words").alias("token")).groupBy("_a", "_b", "token").agg(F.count(F.lit(1)).alias("_n")), "counts")
    used = counts.groupBy("token").agg(F.count(F.lit(1)).alias("_used"))
    met = hot_join(counts, vocabulary.join(used, "token"), "token", "_used", F.xxhash64("_a"), total=counts.count()).join(copies, ["_a", "_b"])
    value = F.col("_n") / F.col("_copies")
    if rows is not None:
        value = value * F.log((F.lit(float(rows)) + 1.0) / (F.col("df") + 1.0))
    entries = F.sort_array(F.collect_list(F.struct("index", value.alias("value"))))
    held = met.groupBy("_a", "_b").agg(entries.alias("_entries"))
    held = settle(copies.join(held, ["_a", "_b"], "left").select(F.struct("_a", "_b").alias("_key"), "_copies", "_entries"), "entries")

    @F.udf(returnType=VectorUDT())
    def vector(indices, values):
        return Vectors.sparse(size, indices or [], values or [])

    rows_of = df.withColumn("_key", F.struct(*_text_keys(text)))
    out = hot_join(rows_of, held, "_key", "_copies", F.monotonically_increasing_id())
    return out.withColumn(target, vector(F.col("_entries.index"), F.col("_entries.value"))).drop("_key", "_entries")


class TextModel(Fitted):
    """native: counts (CountVectorizer model, absent for hashing) and idf (optional).

    Of a large text: state rows (of the fit), weighted; table words (token, index, df) in their place.
    """

    HYPER = {**_TextLearner.HYPER, "n_features": 1 << 18}
    VERBS = _TextLearner.VERBS

    def _transform(self, df: DataFrame) -> DataFrame:
        if "words" in self.tables:
            text = F.coalesce(F.col(self.setting("text_col")), F.lit(""))
            rows = int(self.state["rows"]) if self.state["weighted"] else None
            return joined_vectors(df.drop(self.setting("output_col")), _words(df, self), self.tables["words"], text, self.setting("output_col"), rows)
        out, weighted = _words(df, self), "idf" in self.native
        target = "_counts" if weighted else self.setting("output_col")
        if "counts" in self.native:
            out = self.native["counts"].copy().setInputCol("_words").setOutputCol(target).transform(out)
        else:
            out = HashingTF(numFeatures=self.setting("n_features"), inputCol="_words", outputCol=target).transform(out)
        if weighted:
            idf = self.native["idf"].copy().setInputCol("_counts").setOutputCol(self.setting("output_col"))
            out = idf.transform(out).drop("_counts")
        return out.drop("_words")

    @property
    def vocabulary(self) -> list[str]:
        if "words" in self.tables:
            return [r[0] for r in self.tables["words"].orderBy("index").select("token").collect()]
        return self.native["counts"].vocabulary


class CountVectorizer(_TextLearner):
    """Count vectors over all words, or the most frequent ``max_features`` if that is set.

    The vocabulary is part of the model and kept on the driver, that of more than DRIVER_CHARACTERS of text
    as a table, with which the words are joined.
    """

    HYPER = {"max_features": None, "min_df": 1.0}
    WEIGHTED = False

    def _train(self, df: DataFrame) -> Fitted:
        return self._by_table(df) or TextModel({}, {}, {"counts": self._count(_words(df, self))})

    def _by_table(self, df: DataFrame) -> Fitted | None:
        rows, characters = df.agg(F.count(F.lit(1)), F.sum(F.char_length(self.setting("text_col")))).head()
        if (characters or 0) <= DRIVER_CHARACTERS:
            return None
        words = word_table(_words(df, self), self.setting("min_df"), rows, self.setting("max_features") or ALL_WORDS)
        return TextModel({"rows": rows, "weighted": self.WEIGHTED}, {"words": words})

    def _count(self, words: DataFrame):
        solver = SparkCounts(
            vocabSize=self.setting("max_features") or ALL_WORDS, minDF=self.setting("min_df"), inputCol="_words", outputCol="_counts"
        )
        return solver.fit(words)


class TfidfVectorizer(CountVectorizer):
    """Count vectors weighted by ln((N + 1) / (df + 1))."""

    WEIGHTED = True

    def _train(self, df: DataFrame) -> Fitted:
        if (model := self._by_table(df)) is not None:
            return model
        words = _words(df, self)
        counts = self._count(words)
        idf = IDF(inputCol="_counts", outputCol="_idf").fit(counts.transform(words).select("_counts"))
        return TextModel({}, {}, {"counts": counts, "idf": idf})


class HashingVectorizer(_TextLearner):
    """Counts in ``n_features`` hash buckets; nothing to learn."""

    HYPER = {"n_features": 1 << 18}

    def _train(self, df: DataFrame) -> Fitted:
        return TextModel()
