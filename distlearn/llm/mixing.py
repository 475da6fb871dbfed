"""Mixing sources to target weights, by DataFrame functions alone.

Each document gets a hash-random key. Within a source the keys are put into ranges (leading hex
digits of the key); a sum per range gives the words before it, a window inside the range the rest.
No task sees more of a source than one range, so a source that holds most rows costs no more than
others. The running sums say where each source's budget ends: whole epochs first, then the
documents before the cut, and of the one at the cut the words up to the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import discard
from .common import WORD, row_hash, settle, whole_text

LEAST_DIGITS = 3  # hex digits of the key that name a range: 4096 ranges a source or more
RANGE_ROWS = 1_000_000  # rows a range on average (all sources together), above which another digit is used
MOST_EPOCHS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) -> source, source_size, target, epochs, rest.

    Sources in code point order, null last, take ``weights`` in turn. The shares of all words are
    levelled: target = min(most * size, level * weight), with the level at which targets sum to all
    words. With sources ordered by cap / weight those at their cap come first, and the level is
    the largest of (all words - caps before) / weights from here on. One row per source.
    """
    position = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_at") % len(weights) + 1).cast("int"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_weight"), "_at")
    before = F.coalesce(F.sum("_cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum("_weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy(F.lit(1))
    levelled = (
        sizes.withColumn("_at", position)
        .withColumn("_weight", weight)
        .withColumn("_cap", F.col("source_size") * most)
        .withColumn("_all", F.sum("source_size").over(everything))
        .withColumn("_level", (F.col("_all") - before).cast("double") / onward)
        .withColumn("_level", F.max("_level").over(everything))
    )
    target = F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_weight"))
    budget = F.floor(F.col("target") + 0.5)
    return (
        levelled.withColumn("target", target)
        .withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0))
        .withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
        .select("source", "source_size", "target", "epochs", "rest")
    )


def _key(seed: str) -> Column:
    """The hash-random key of a document: of its doc_id, or of its text where that is null."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null"), F.md5(whole_text().cast("binary"))))
    return F.md5(F.concat(F.lit(seed), name).cast("binary"))


def _range_digits(rows: int) -> int:
    """Leading hex digits of the key that name a range: RANGE_ROWS a range on average, or fewer."""
    digits = LEAST_DIGITS
    while rows > RANGE_ROWS * 16**digits:
        digits += 1
    return digits


def _placed(rows: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """(source, key, size, further columns) -> one row per different one, with its place in the mixture.

    Adds ``n`` (how many rows are equal), source_size, target, ``epochs`` that all take whole, and ``rest``: the words
    of the last, cut epoch that go to these n rows together. Equal rows are counted before they are sorted, so a
    row that repeats often is one row here.
    """
    named = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # null apart from every name
    digits = _range_digits(rows.count())  # of a written table: the counts of its files
    further = [c for c in rows.columns if c not in ("source", "key", "size")]
    equal = rows.groupBy("source", "key", "size", *further).agg(F.count(F.lit(1)).alias("n")).withColumn("range", F.substring("key", 1, digits)).withColumn("named", named)
    words = F.col("size") * F.col("n")
    ranges = rows.groupBy("source", F.substring("key", 1, digits).alias("range")).agg(F.sum("size").alias("words"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights)
    earlier = Window.partitionBy("named").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranges.withColumn("named", named)
        .withColumn("start", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
        .select("named", "range", "start")
        .join(targets.withColumnRenamed("rest", "budget").withColumn("named", named).drop("source"), "named")
    )
    inside = Window.partitionBy("named", "range").orderBy("key", "size", *further).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.col("inside")
    return (
        equal.withColumn("inside", F.coalesce(F.sum(words).over(inside), F.lit(0)))
        .join(starts, ["named", "range"])
        .withColumn("rest", F.greatest(F.lit(0), F.least(words, F.col("budget") - before)).cast("long"))
        .withColumn("epochs", F.col("epochs").cast("int"))
        .select("source", "named", "key", "size", *further, "n", "source_size", "target", "epochs", "rest")
    )


def plan_mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """doc_id, size, source_size, target, taken (+ epochs and part: words of the last, cut epoch).

    Null texts have size 0 and take nothing; a null source is one source of its own. Rows with one
    doc_id share a key and follow each other; rows with a null doc_id have the key of their text. Which of two
    equal rows comes first does not change the result. An empty table gives an empty result. Other columns are not read.
    """
    sized = settle(docs.select("doc_id", "source", _key(seed).alias("key"), F.regexp_count(whole_text(), F.lit(WORD)).cast("long").alias("size")), "sizes")
    number = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - (F.col("number") - 1) * F.col("size")))
    return (
        _placed(sized, weights)
        .withColumn("number", number)
        .withColumn("part", part.cast("long"))
        .withColumn("taken", (F.col("epochs") * F.col("size") + F.col("part")).cast("long"))
        .select("doc_id", "size", "source_size", "target", "taken", "epochs", "part")
    )


def mix(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The mixture itself: each document once per epoch it is taken, with the columns of ``docs``.

    A document without words is kept once (it costs nothing). The document at the cut of a source
    appears in the last epoch with its first words up to the budget, joined by one space; all
    others are whole. Every row is taken for itself, by its own source and size, also where doc_ids are shared or null;
    so the words of the mixture are ``taken`` of ``plan_mix`` in every source. Of rows equal in all
    columns as many are taken as the budget allows. An empty table gives an empty one; columns may have any name and type.
    """
    words = F.regexp_count(whole_text(), F.lit(WORD)).cast("long")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key(seed).alias("key"), F.col("source").alias("source"), words.alias("size"), row_hash(docs).alias("tie")
    )
    sized = settle(rows.drop("row"), "sizes")
    plan = settle(_placed(sized, weights).select("named", "key", "size", "tie", "n", "epochs", "rest"), "places")
    discard(sized)
    by = ["named", "key", "size", "tie"]
    met = rows.withColumn("named", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).drop("source").join(plan, by)
    # equal rows that the cut goes through: all take the whole epochs, one of them stands for what the last epoch takes
    through = (F.col("n") > 1) & (F.col("rest") > 0) & (F.col("rest") < F.col("n") * F.col("size"))
    last = F.when(through | (F.col("rest") == 0), 0).otherwise(1)
    copies = F.when(F.col("size") == 0, 1).otherwise(F.col("epochs") + last)
    cut = (F.col("n") == 1) & (F.col("rest") < F.col("size")) & (F.col("copy") > F.col("epochs"))
    out = _copied(met, copies, cut, F.col("rest"), docs.columns)
    if not plan.where(through).isEmpty():
        whole = F.floor(F.col("rest") / F.col("size"))
        left = F.col("rest") - whole * F.col("size")
        one = met.where(through).groupBy(*by, "rest").agg(F.first("row").alias("row"))  # equal rows, so any of them
        out = out.unionByName(_copied(one, whole + F.when(left > 0, 1).otherwise(0), F.col("copy") > whole, left, docs.columns))
    return out


def _copied(rows: DataFrame, copies: Column, cut: Column, part: Column, columns: list[str]) -> DataFrame:
    """``copies`` of each row; where ``cut`` is true (of the number ``copy``) with its first ``part`` words only."""
    taken = rows.where(copies > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
    words = F.regexp_extract_all(F.col("row.text"), F.lit(WORD), F.lit(0))
    text = F.when(cut, F.array_join(F.slice(words, 1, part.cast("int")), " ")).otherwise(F.col("row.text"))
    return taken.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in columns])
