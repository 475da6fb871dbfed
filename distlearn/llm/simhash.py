"""Near-duplicate texts by SimHash fingerprints, found through deletion-variant signatures.

Two fingerprints of 64 bits that differ in at most three bits are cut into two halves; one half then
differs in at most one bit. Every half is indexed under its 32 variants with one bit left out, so
such halves share a variant, and an equality join finds all pairs; the full fingerprints are
compared afterwards. Equal fingerprints are one class from the start, and so are equal halves, so copies
cost nothing here.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import connected_components
from ..plans.lineage import discard
from .common import each_key, paired_pieces, settle

WORDS = 3  # words of a shingle
SEED = 42
NEAR = 3  # bits
HALF = 32
BUCKET = 2_048  # fingerprints that meet and that one task compares with each other


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """SimHash of the lower-cased text's word shingles; 0 without words."""
    found = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    if not found:
        return 0
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words))))
    count = max(1, len(found) - words + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, count)
    ones = np.zeros(64, np.int64)
    for start in range(0, count, 8192):
        bits = np.unpackbits(hashes[start : start + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint16)
    return int(np.packbits(ones * 2 > count, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, fp (64 bits as a long): one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), words) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def halves(classes: DataFrame) -> DataFrame:
    """(side, half, fp): both halves of each fingerprint."""
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    both = F.array(*[F.struct(F.lit(i).alias("side"), h.alias("half")) for i, h in enumerate((F.shiftrightunsigned("fp", HALF), low))])
    return classes.select("fp", F.explode(both).alias("_h")).select("_h.side", "_h.half", "fp")


def neighbouring_halves(known: DataFrame) -> DataFrame:
    """(side, half, met): halves that differ in one bit, under the variant they share.

    ``known`` has each half once, so a variant has two halves at most: with its bit and without.
    Spark's partial sums and one number per variant are all that is shuffled.
    """
    at, half = F.col("_at"), F.col("half")
    one = F.lit(1).cast("bigint")
    bit = F.call_function("shiftleft", one, at)
    number = F.call_function("shiftleft", (F.col("side") * HALF + at).cast("bigint"), F.lit(HALF))
    rows = known.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(HALF - 1)))).select(
        number.bitwiseOR(half.bitwiseAND(F.bitwise_not(bit))).alias("met"), F.when(half.bitwiseAND(bit) == 0, 1).otherwise(2).cast("tinyint").alias("_seen")
    )
    shared = rows.groupBy("met").agg(F.bit_or("_seen").alias("_seen")).where("_seen = 3")
    place = F.shiftrightunsigned("met", HALF).cast("int")
    without = F.col("met").bitwiseAND(F.lit(0xFFFFFFFF))
    pair = F.array(without, without.bitwiseOR(F.call_function("shiftleft", one, place % HALF)))
    return shared.select(F.floor(place / HALF).cast("int").alias("side"), F.explode(pair).alias("half"), "met")


def spanning_links(values: np.ndarray, near: int = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what lies within ``near`` bits of each other, at most one per value.

    Grows one component after another: each value found leaves the rest, so dense groups cost little
    more than their size.
    """
    sources, targets, rest = [], [], values
    while len(rest) > 1:
        frontier, rest = rest[:1], rest[1:]
        while len(frontier) and len(rest):
            block, frontier = frontier[:32], frontier[32:]
            hit = np.bitwise_count(block[:, None] ^ rest[None, :]) <= near
            found = hit.any(axis=0)
            if found.any():
                sources.append(block[hit[:, found].argmax(axis=0)])
                targets.append(rest[found])
                frontier, rest = np.concatenate([frontier, rest[found]]), rest[~found]
    none = np.zeros(0, values.dtype)
    return np.concatenate([none, *sources]), np.concatenate([none, *targets])


def links(classes: DataFrame, bucket: int = BUCKET, near: int = NEAR) -> DataFrame:
    """(u, v): links between different fingerprints that connect all within ``near`` bits.

    Fingerprints meet if they share a half, or if halves of theirs share a variant. What meets is
    compared in one task, in pieces where it is much, and gives a spanning set of links, never all pairs.
    """
    if near > NEAR:
        raise ValueError(f"two halves find {NEAR} bits at most; use near_copies for texts further apart")
    rows = halves(classes)
    known = settle(rows.groupBy("side", "half").agg(F.count(F.lit(1)).alias("n")), "halves")
    own = F.call_function("shiftleft", (F.col("side") + 2 * HALF).cast("bigint"), F.lit(HALF)).bitwiseOR(F.col("half"))
    equal = known.where("n > 1").select("side", "half", own.alias("met"))
    meeting = settle(neighbouring_halves(known.select("side", "half")).unionByName(equal), "meeting")
    dealt = paired_pieces(rows.join(meeting, ["side", "half"]).select("met", "fp"), ["met"], F.xxhash64("fp"), bucket)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in each_key(batches, ["met", "piece", "other"]):
            u, v = spanning_links(group.column("fp").to_numpy().view(np.uint64), near)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    out = settle(dealt.mapInArrow(run, "u long, v long"), "links")
    discard(known, meeting)
    return out


def near_duplicates(docs: DataFrame, words: int = WORDS, near: int = NEAR) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id reachable over links, the document's own included.

    Texts without words (null, empty) have fingerprint 0 and link like any other; each row gives one
    row, repeated ids included; an empty table gives an empty result. Other columns are not read. A
    fingerprint that many documents share is a hot key of the last join only, which Spark splits.
    """
    marked = settle(fingerprints(docs, words), "fingerprints")
    classes = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    linked = links(classes, near=near)
    found = connected_components(linked)
    rooted = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = settle(rooted, "rooted")
    discard(classes, linked)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")
