"""Removing passages that repeat across documents, with Aho-Corasick automata.

A window of 50 words holds 26 phrases of 25 words; the one with the smallest hash stands for the
window. Equal windows choose equal phrases, so only windows whose phrase occurs in several documents can
repeat, and a document has about one such phrase per 13 words.

1. One row (phrase, document) for each chosen phrase; phrases of two or more documents recur.
2. Every document with a recurring phrase is streamed through an automaton (pyahocorasick) of the recurring
   phrases of its block of documents: the automata are sharded by block, so their size has a bound
   and every document is streamed once. The occurrences found there confirm the phrases word by word
   and give the stretches of windows around them.
3. Equal stretches are compared by their fingerprints; the few stretches that share a phrase but not
   all words are compared window by window. A window is judged by the smallest document it starts in.
4. Covered words leave the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import discard
from .common import settle, whole_text

WINDOW = 50
PHRASE = 25
BLOCK_BYTES = 1 << 18  # of text whose phrases go into one automaton
ROWS = 512  # handled at a time
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

_POWERS: dict[int, np.ndarray] = {}


def powers(base: np.uint64, count: int) -> np.ndarray:
    """base ** 0 .. base ** (count - 1), modulo 2^64."""
    known = _POWERS.get(int(base))
    if known is None or len(known) < count:
        known = np.full(max(count, 1 << 15), base, np.uint64)
        known[0] = 1
        known = _POWERS[int(base)] = np.cumprod(known, dtype=np.uint64)
    return known[:count]


class Prints:
    """Fingerprints of stretches of one document's words, each from two entries of a running sum."""

    def __init__(self, words: list[bytes]):
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(hashes * powers(BASE, len(words)), out=self.sums[1:])
        self.back = powers(INVERSE, len(words) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.back[starts])

    def all_of(self, length: int) -> np.ndarray:
        """Of each stretch of ``length`` words, by its start."""
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.back[:n]) if n > 0 else np.zeros(0, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbouring values, by doubling."""
    if len(values) < width:
        return values[:0]
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out, have = np.minimum(out[: len(out) - step], out[step:]), have + step
    return out


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes: ASCII white space only


def chosen_phrases(docs: DataFrame, window: int, phrase: int) -> DataFrame:
    """(phrase, doc_id): fingerprints of the phrases that stand for the windows of a document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                found, counts = [np.zeros(0, np.uint64)], []
                for text in part.column(1):
                    words = words_of(text.as_py())
                    own = np.unique(least_of(Prints(words).all_of(phrase), window - phrase + 1)) if len(words) >= window else found[0]
                    found.append(own)
                    counts.append(len(own))
                ids = np.repeat(part.column(0).to_numpy(), counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(ids)], ["phrase", "doc_id"])

    return docs.select("doc_id", "text").mapInArrow(run, "phrase long, doc_id long")


def locate(texts: list[list[bytes]], recurring: list[np.ndarray], phrase: int) -> Iterator[tuple[Prints, np.ndarray]]:
    """For each document of a block, its fingerprints and where a recurring phrase starts.

    One automaton holds the words of all phrases that recur in the block's documents; each document is
    streamed through it once.
    """
    automaton, prints, marks = ahocorasick.Automaton(), [], set()
    for words, asked in zip(texts, recurring):
        own = Prints(words)
        prints.append(own)
        grams = own.all_of(phrase)
        for at in np.flatnonzero(np.isin(grams, asked)):
            if (mark := int(grams[at])) not in marks:
                marks.add(mark)
                automaton.add_word(" " + b" ".join(words[at : at + phrase]).decode("latin-1") + " ", 1)
    if marks:
        automaton.make_automaton()
    for words, own in zip(texts, prints):
        if not marks:
            yield own, np.zeros(0, np.int64)
            continue
        stream = " " + b" ".join(words).decode("latin-1") + " "
        ends = np.fromiter((end for end, _ in automaton.iter(stream)), np.int64)
        spaces = np.cumsum([1 + len(w) for w in words])  # the space after each word
        yield own, np.searchsorted(spaces, ends) - phrase + 1


def stretches_of(own: Prints, located: np.ndarray, window: int, phrase: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(phrase, stretch, first window, windows, fingerprints of the windows) of one document.

    A stretch is a run of windows for which the same phrase stands.
    """
    grams = own.all_of(phrase)
    least = least_of(grams, window - phrase + 1)
    if not len(least) or not len(located):
        return
    edges = np.flatnonzero(least[1:] != least[:-1]) + 1
    first, last = np.concatenate([[0], edges]), np.concatenate([edges, [len(least)]])
    kept = np.isin(least[first], grams[located])
    first, last = first[kept], last[kept]
    whole = own.of(first, last + window - 1).view(np.int64)
    marks = least[first].view(np.int64)
    windows = own.all_of(window)
    for a, b, mark, stretch in zip(first.tolist(), last.tolist(), marks.tolist(), whole.tolist()):
        yield mark, stretch, a, b - a, windows[a:b].tobytes()


def stretches(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(doc_id, copy, phrase, stretch, first, n, windows): stretches around recurring phrases.

    ``copy`` is a hash of the text, which tells rows of one doc_id apart.
    """
    named = docs.where(F.col("doc_id").isNotNull())
    chosen = settle(chosen_phrases(named, window, phrase), "phrases")
    # tables on their own, here and below: a join of plain exchanges is one whose hot keys Spark can split
    recurring = settle(chosen.groupBy("phrase").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("phrase"), "recurring")
    lists = chosen.join(recurring, "phrase").groupBy("doc_id").agg(F.collect_set("phrase").alias("phrases"))  # once each, also where rows repeat
    lists = settle(lists, "lists")
    met = named.select("doc_id", whole_text().alias("text")).join(lists, "doc_id")
    met = met.select("doc_id", F.xxhash64("text").alias("copy"), "text", "phrases")

    def block_rows(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        texts = [words_of(r[2]) for r in rows]
        asked = [np.array(r[3], np.int64).view(np.uint64) for r in rows]
        for row, (own, located) in zip(rows, locate(texts, asked, phrase)):
            out += [(row[0], row[1], *s) for s in stretches_of(own, located, window, phrase)]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        names = ["doc_id", "copy", "phrase", "stretch", "first", "n", "windows"]
        columns = list(zip(*out)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                held.append(tuple(c[i].as_py() for c in batch.columns))
                size += len(held[-1][2])
                if size >= BLOCK_BYTES:
                    yield block_rows(held)
                    held, size = [], 0
        if held:
            yield block_rows(held)

    fields = "doc_id long, copy long, phrase long, stretch long, first int, n int, windows binary"
    out = settle(met.mapInArrow(run, fields), "stretches")
    discard(chosen, recurring, lists)
    return out


def covered(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """(doc_id, copy, spans): word ranges covered by windows that start in a smaller document too.

    Stretches that equal one of a smaller document are covered as a whole. The first of each kind is
    compared by its windows, and only where its phrase has stretches of other kinds.
    """
    found = stretches(docs, window, phrase)
    kinds = found.groupBy("phrase", "stretch", "n").agg(F.min("doc_id").alias("least"))
    kinds = settle(kinds, "kinds")
    mixed_phrases = settle(kinds.groupBy("phrase").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select("phrase"), "mixed")
    judged = found.join(kinds, ["phrase", "stretch", "n"])
    whole = judged.where("least < doc_id").select("doc_id", "copy", F.col("first").alias("start"), (F.col("first") + F.col("n") + window - 1).alias("end"))
    firsts = judged.where("least = doc_id").join(mixed_phrases, "phrase").select("doc_id", "copy", "phrase", "first", "windows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            data = [x.as_py() for x in batch.column("windows")]
            counts = np.array([len(x) // 8 for x in data])
            order = np.repeat(np.arange(batch.num_rows), counts)
            inside = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
            taken = batch.take(pa.array(order)).drop_columns(["windows", "first"])
            first = batch.column("first").to_numpy()[order] + inside
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(first.astype(np.int32)), pa.array(np.frombuffer(b"".join(data), np.int64))], [*taken.schema.names, "start", "print"]
            )

    single = settle(firsts.mapInArrow(run, "doc_id long, copy long, phrase long, start int, print long"), "windows")
    shared = single.groupBy("phrase", "print").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    shared = settle(shared, "shared")
    apart = single.join(shared, ["phrase", "print"]).where("least < doc_id").select("doc_id", "copy", "start", (F.col("start") + window).alias("end"))
    spans = F.collect_set(F.struct("start", "end")).alias("spans")  # no more than the text has words, also where rows repeat
    out = settle(whole.unionByName(apart).groupBy("doc_id", "copy").agg(spans), "covered")
    discard(found, kinds, mixed_phrases, single, shared)
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space): one row per row.

    A word goes if a window of ``window`` words covers it whose words also start in a document with a
    smaller doc_id; windows are judged on the texts as they come. Texts that are null, empty or
    shorter than a window lose nothing; rows without an id are compared with nothing, and rows that
    share an id don't remove from each other. An empty table gives an empty result. Other columns
    are not read.
    """
    spans = covered(docs, window, phrase).withColumnRenamed("doc_id", "_doc").withColumnRenamed("copy", "_copy")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    met = texts.join(spans, (F.col("doc_id") == F.col("_doc")) & (F.xxhash64("text") == F.col("_copy")), "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            totals, gone, kept = [], [], []
            for text, own in zip(batch.column("text"), batch.column("spans")):
                words = words_of(text.as_py())
                cover = np.zeros(len(words) + 1, np.int64)
                for span in own.as_py() or ():
                    cover[span["start"]] += 1
                    cover[span["end"]] -= 1
                removed = np.cumsum(cover[:-1]) > 0
                totals.append(len(words))
                gone.append(int(removed.sum()))
                kept.append(b" ".join(w for w, r in zip(words, removed) if not r) if gone[-1] else b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "kept"],
            )

    return met.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")
