"""Grouping spelling variants: words that differ by one letter, found with bit-sliced position indexes.

A block of words is indexed by one bitset for each (position, letter): bit w is set if word w has that letter there.
All words of the block are looked up at once: reading a word letter by letter, one bitset follows the words that agree so
far, and three more those with one error behind them: a letter replaced (same position), one too many in the other word (the
position after) or one missing there (the position before). Each step is an AND or OR over 64 words at a time.

Two words one error apart agree before or after the middle of the shorter one, so they meet in a block of words with the same
first half or the same second half. Blocks with too many words are halved again in the part that may differ, until a
block is small: in the end one position differs, and so few words exist. Small blocks share an index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import discard
from .common import each_key, settle, whole_text

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TYPOS = 31  # one run in so many loses a letter
LEAST_LENGTH, LEAST_COUNT = 7, 2
BLOCK = 2_048  # words that one index holds; larger blocks are halved
RATIO = 10  # how much commoner a word's form is


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the different words of at least 7 letters that occur twice or more, after the planted typos.

    A null id counts as an empty string in a run's hash, a null text as one without words.
    """
    runs = docs.select(
        F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.translate(whole_text(f"`{text}`"), UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"),
    ).where(F.char_length("run") >= LEAST_LENGTH)
    h = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    without = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
    words = h.select(F.when(F.col("h") % TYPOS == 0, without).otherwise(F.col("run")).alias("word"))
    counted = words.where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def _halved(rows: DataFrame) -> DataFrame:
    """Each row once for either half of the part lo..hi in which it may differ, with the block that it then belongs to.

    ``lo``, ``hi`` count in the shorter word of a pair, of length ``m``; a word is the shorter or the longer one.
    """
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    halves = F.array(F.struct(middle.alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("lo").alias("lo"), middle.alias("hi")))
    cut = rows.withColumn("half", F.explode(halves)).select("word", "n", "m", "half.lo", "half.hi")
    same = cut.where("lo < hi")
    before = F.col("word").substr(F.lit(1), F.col("lo"))
    after = F.col("word").substr(F.char_length("word") - (F.col("m") - F.col("hi")) + 1, F.col("m") - F.col("hi"))
    return same.withColumn("block", F.xxhash64("m", "lo", "hi", before, after))


def _blocks(words: DataFrame, limit: int) -> DataFrame:
    """Rows of words with their blocks of at most ``limit`` rows; a pair that is one error apart meets in one block or more."""
    length = F.char_length("word")
    rows = words.withColumn("m", F.explode(F.array(length, length - 1))).select("word", "n", "m", F.lit(0).alias("lo"), F.col("m").alias("hi"))
    done = None
    while True:
        rows = _halved(rows)
        hot = settle(rows.groupBy("block", "hi", "lo").count().where((F.col("count") > limit) & (F.col("hi") - F.col("lo") > 1)).select("block").distinct(), "hot_blocks")
        some = not hot.isEmpty()
        small = rows.join(hot, "block", "left_anti") if some else rows
        done = small if done is None else done.unionByName(small)
        if not some:
            discard(hot)
            return done
        rows = settle(rows.join(hot, "block", "left_semi"), "large_blocks")


class PositionIndex:
    """Bitsets by position and letter over the words of a block, made position by position."""

    def __init__(self, words: list[str]):
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        self.lanes = -(-len(words) // 64)

    def bits(self, chosen: np.ndarray) -> np.ndarray:
        """Rows of booleans over the words as rows of 64-bit lanes."""
        padded = np.zeros((*chosen.shape[:-1], 64 * self.lanes), bool)
        padded[..., : chosen.shape[-1]] = chosen
        return np.packbits(padded, axis=-1, bitorder="little").view("<u8")

    def letters_at(self, i: int) -> np.ndarray:
        """The letter of each word at a position; 0 past its ends."""
        inside = (0 <= i) & (i < self.lengths)
        return np.where(inside, self.points[np.where(inside, self.starts + i, 0)], 0)

    def at(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The letters that occur at a position, sorted, and for each the bitset of the words that have it there."""
        here = self.letters_at(i)
        letters = np.unique(here[here > 0])
        return letters, self.bits(here[None, :] == letters[:, None])


def _pick(slices: tuple[np.ndarray, np.ndarray], letters: np.ndarray, lanes: int) -> np.ndarray:
    """The bitset of each letter, empty for those that don't occur."""
    known, bitsets = slices
    if not len(known):
        return np.zeros((len(letters), lanes), np.uint64)
    at = np.minimum(np.searchsorted(known, letters), len(known) - 1)
    found = bitsets[at]
    found[known[at] != letters] = 0
    return found


def near_pairs(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (i, j) of all words exactly one insertion, deletion or replacement apart, both ways round."""
    index = PositionIndex(words)
    lengths, lanes, longest = index.lengths, index.lanes, int(index.lengths.max(initial=0))
    order = np.argsort(-lengths, kind="stable")  # longest first, so that words still being read are the first ones
    words_left = np.searchsorted(-lengths[order], -np.arange(longest + 2), side="left")  # words longer than i
    same = np.tile(index.bits(np.ones((1, len(words)), bool)), (len(words), 1))
    swapped, longer, shorter = (np.zeros_like(same) for _ in range(3))
    before, here, after = (np.zeros(0, np.uint32), np.zeros((0, lanes), np.uint64)), index.at(0), index.at(1)
    for i in range(longest):
        k = words_left[i]
        letter = index.letters_at(i)[order[:k]]
        agree, same_k = _pick(here, letter, lanes), same[:k]
        there = index.bits((lengths > i)[None, :])
        shorter[:k] = shorter[:k] & _pick(before, letter, lanes) | same_k
        longer[:k] = (longer[:k] | same_k) & _pick(after, letter, lanes)
        swapped[:k] = swapped[:k] & agree | same_k & ~agree & there
        same[:k] = same_k & agree
        before, here, after = here, after, index.at(i + 2)
    longer |= same  # a letter too many at the end
    mine = lengths[order]
    of_length = {int(x): index.bits((lengths == x)[None, :])[0] for x in np.unique(lengths)}
    none = np.zeros(lanes, np.uint64)
    for x in np.unique(mine):
        a, b = np.searchsorted(-mine, [-x, -x + 1])
        swapped[a:b] &= of_length[int(x)]
        longer[a:b] &= of_length.get(int(x) + 1, none)
        shorter[a:b] &= of_length.get(int(x) - 1, none)
    found = swapped | longer | shorter
    i, lane = np.nonzero(found)
    near = np.unpackbits(found[i, lane][:, None].view(np.uint8), axis=1, bitorder="little")
    which, bit = np.nonzero(near)
    return order[i[which]], 64 * lane[which] + bit


def _block_links(part: pa.Table) -> pa.RecordBatch:
    """Each word's near words in its blocks, as a number and the commonest; a pair counts in one of the blocks it meets in."""
    words = part.column("word").to_pylist()
    n, m, lo, hi, block = (part.column(c).to_numpy() for c in ("n", "m", "lo", "hi", "block"))
    i, j = near_pairs(words)
    meant = (block[i] == block[j]) & (m[i] == m[j]) & (lo[i] == lo[j]) & (hi[i] == hi[j])
    lengths = np.array([len(w) for w in words], np.int64)
    meant &= np.minimum(lengths[i], lengths[j]) == m[i]
    i, j = i[meant], j[meant]
    counted = np.zeros(len(words), np.int64)
    best: list[tuple[int, str] | None] = [None] * len(words)
    for a, b in zip(i.tolist(), j.tolist()):
        x, y = words[a], words[b]
        start, end, rest = lo[a], hi[a], m[a] - hi[a]
        if x[:start] != y[:start] or (rest and x[-rest:] != y[-rest:]):  # blocks of equal hash
            continue
        if rest and x[:end] == y[:end]:  # they agree further, so they meet in a block further right
            continue
        counted[a] += 1
        candidate = (-int(n[b]), y)
        if best[a] is None or candidate < best[a]:
            best[a] = candidate
    rows = [k for k in range(len(words)) if counted[k]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([words[k] for k in rows], pa.string()), pa.array(counted[rows], pa.int64()),
            pa.array([best[k][0] for k in rows], pa.int64()), pa.array([best[k][1] for k in rows], pa.string()),
        ],
        ["word", "n_near", "less", "form"],
    )


def near_words(words: DataFrame, limit: int = BLOCK) -> DataFrame:
    """(word, n_near, form, form_n) for words of (word, n) that have near words: their number and the commonest one.

    Ties go to the smallest in code-point order. Complete: no pair is dropped, whatever the sizes of the blocks.
    """
    rows = settle(_blocks(words, limit), "blocks")
    bins = max(1, -(-rows.count() // limit))
    long = F.least(F.floor(F.log2(F.greatest(F.col("m"), F.lit(1)) / 16)), F.lit(32)).cast("int")  # very long words keep to themselves
    dealt = rows.withColumn("bin", F.pmod(F.xxhash64("block"), F.lit(bins))).withColumn("long", F.greatest(long, F.lit(0)))
    dealt = dealt.repartition("long", "bin").sortWithinPartitions("long", "bin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in each_key(batches, ["long", "bin"]):
            yield _block_links(part)

    links = dealt.mapInArrow(run, "word string, n_near long, less long, form string")
    met = links.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "form")).alias("best"))
    found = settle(met.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n")), "near_words")
    discard(rows)
    return found


def _rooted(forms: DataFrame) -> DataFrame:
    """(word, root): follow word -> form to the last. Each form is at least RATIO times as common, so paths are short and end."""
    now = settle(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = settle(now.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if new.where("moved").isEmpty():
            return new.drop("moved")
        now = new.select("word", "root")


def group_spellings(docs: DataFrame, limit: int = BLOCK, ratio: int = RATIO) -> DataFrame:
    """One row per word of :func:`vocabulary`: word, form, root, n, n_near, form_n.

    ``form`` is the commonest near word if it occurs ``ratio`` times as often, else null; ``root`` the end of the path of forms,
    the word itself if it has none. Null or empty texts and rows without an id are as in :func:`vocabulary`; repeated rows all
    count; words of any length are compared whole; an empty table gives no rows; further columns play no part.
    """
    words = settle(vocabulary(docs), "words")
    near = near_words(words, limit)
    fits = F.col("form_n") >= ratio * F.col("n")
    joined = words.join(near, "word", "left").select(
        "word", F.when(fits, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("form_n")).alias("form_n")
    )
    roots = _rooted(joined.where("form is not null"))
    return joined.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
