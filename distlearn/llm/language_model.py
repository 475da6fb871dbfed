"""Scoring texts by a bigram model with deleted interpolation.

P(w | h) = a * c(h, w) / c(h) + b * c(w) / N + (1 - a - b) / (V + 1)

The weights a, b depend on how often the history h was seen (buckets of powers of two). They are
learned by expectation-maximisation on documents whose counts are left out ("deleted"); the final
counts are those of all training documents. The history is the word before itself; the end of a text
stands before its first word, so every token is a history once and c(h) is the count of the word h.
Words and pairs of words are known by 64-bit hashes; nothing of their number is bounded.

Layout: documents are taken in chunks. A chunk sends its distinct words and pairs with their counts to
the parts of the corpus, which are ranges of the hashes; a part adds up what all chunks sent and sends each
chunk the totals of what it asked for. A word or pair is one record a chunk, however frequent it is,
so no part is hot. The chunk then has all counts of its own tokens and scores its documents whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import discard
from .common import each_key, pack, settle, unpack

CHUNK_TOKENS = 2_000_000
CHUNK_DOCS = 60_000
TOKENS_AT_ONCE = 1 << 18  # whose probabilities are held
PART_BYTES = 32 << 20  # of text per part
LEAST_PARTS = 8
FREQUENT = 2_000  # words from this share (1 / FREQUENT) of a chunk on have its smallest numbers, which pack well
HELD_BACK = 10  # one in so many training documents is left out to learn the weights
STEP = 0.02  # of the logarithms of probabilities that the weights are learned from
END = np.uint64(xxhash.xxh64_intdigest(b""))  # end of a text, and the history of its first word
TEST, COUNTED, DELETED = 0, 1, 2  # roles of documents


def tokens(text: str | None) -> np.ndarray:
    """Hashes of the words of the lower-cased text, then the end."""
    words = (text or "").encode().lower().split()  # bytes: ASCII letters and ASCII white space only
    out = np.empty(len(words) + 1, np.uint64)
    out[:-1] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    out[-1] = END
    return out


def before(values: np.ndarray, lengths: np.ndarray, first: int) -> np.ndarray:
    """The value of the token before each token of texts of these lengths; ``first`` stands before a text."""
    out = np.empty_like(values)
    out[1:] = values[:-1]
    out[np.cumsum(lengths) - lengths] = first
    return out


def pairs_of(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash of each token's word and the word before it."""
    return before(words, lengths, END) * np.uint64(0x9E3779B97F4A7C15) + words


FIELDS = "kind int, chunk long, part int, " + ", ".join(f"p{i} binary" for i in range(6)) + ", " + ", ".join(f"n{i} long" for i in range(4))
NAMES = [f.split()[0] for f in FIELDS.split(", ")]
TEXTS, ASKED, TOTALS, SUMS, ESTIMATE, COUNTS = range(6)  # kinds of rows


def row(kind: int, chunk: int = -1, part: int = -1, packed: tuple = (), numbers: tuple = ()) -> pa.RecordBatch:
    values = [kind, chunk, part, *packed, *[None] * (6 - len(packed)), *numbers, *[None] * (4 - len(numbers))]
    kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 6, *[pa.int64()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], NAMES)


def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def tallies(number: np.ndarray, of_token: np.ndarray, distinct: int) -> np.ndarray:
    """How often each number stands in counted and in deleted documents."""
    return np.stack([np.bincount(number[of_token == r], minlength=distinct) for r in (COUNTED, DELETED)]).astype(np.int64)


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def text_row(chunk: int, ids: list, roles: list[int], texts: list[np.ndarray]) -> pa.RecordBatch:
    """The texts of one chunk as numbers of words."""
    words = np.concatenate(texts)
    names, number, n = np.unique(words, return_inverse=True, return_counts=True)
    often = n * FREQUENT >= len(words)
    order = np.concatenate([np.flatnonzero(often)[np.argsort(-n[often], kind="stable")], np.flatnonzero(~often)])
    rank = np.empty(len(names), np.uint32)
    rank[order] = np.arange(len(names))
    known, missing = np.array([0 if i is None else i for i in ids], np.int64), np.array([i is None for i in ids], np.uint8)
    columns = known, missing, np.array([len(t) for t in texts], np.int64), np.array(roles, np.uint8)
    return row(TEXTS, chunk, packed=(*map(pack, columns), pack_sorted(names[order]), pack(rank[number])))


class Chunk:
    """The texts of one chunk again, by sorted words and pairs."""

    def __init__(self, texts: dict):
        self.lengths, self.role = unpack(texts["p2"], np.int64), unpack(texts["p3"], np.uint8)
        names, stream = unpack_sorted(texts["p4"]), unpack(texts["p5"], np.uint32)
        order = np.argsort(names)
        rank = np.empty(len(names), np.uint32)
        rank[order] = np.arange(len(names))
        self.names, self.word = names[order], rank[stream]  # distinct words; of each token the place of its word
        self.pairs, self.pair = np.unique(pairs_of(names[stream], self.lengths), return_inverse=True)

    def asked(self, chunk: int, parts: int) -> Iterator[pa.RecordBatch]:
        """Rows of what the chunk asks of each part, with its own counts."""
        of_token = np.repeat(self.role, self.lengths)
        own = [(keys, tallies(number, of_token, len(keys))) for keys, number in ((self.names, self.word), (self.pairs, self.pair))]
        width = (1 << 64) // parts + 1
        edges = np.array([i * width for i in range(1, parts)], np.uint64)
        ends = [[0, *np.searchsorted(keys, edges), len(keys)] for keys, _ in own]
        for part in range(parts):
            cuts = [slice(e[part], e[part + 1]) for e in ends]
            if any(c.start < c.stop for c in cuts):
                yield row(ASKED, chunk, part, tuple(p for (keys, counts), c in zip(own, cuts) for p in (pack_sorted(keys[c]), pack(counts[:, c].ravel()))))


def part_rows(group: pa.Table) -> Iterator[pa.RecordBatch]:
    """Rows of one part: for each chunk the totals of the words and pairs it asked for; the part's distinct words and tokens."""
    answers = [[] for _ in range(group.num_rows)]
    for at in (0, 2):  # words, then pairs
        keys = [unpack_sorted(k.as_py()) for k in group.column(f"p{at}")]
        ends = np.cumsum([len(k) for k in keys])[:-1]
        names, number = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        sent = [unpack(c.as_py(), np.int64).reshape(2, -1) for c in group.column(f"p{at + 1}")]
        totals = [np.bincount(number, np.concatenate([c[i] for c in sent]), minlength=len(names)).astype(np.int64) for i in (0, 1)]
        del sent
        for answer, own in zip(answers, np.split(number, ends)):
            answer.extend(pack(t[own]) for t in totals)
        if at == 0:
            yield row(COUNTS, numbers=(int((totals[0] + totals[1] > 0).sum()), int(totals[0].sum()), int(totals[1].sum())))
    for chunk, part, answer in zip(group.column("chunk").to_pylist(), group.column("part").to_pylist(), answers):
        yield row(TOTALS, chunk, part, tuple(answer))


def counted_rows(group: pa.Table, counted_tokens: int) -> Iterator[pa.RecordBatch]:
    """Rows of one chunk from its texts and the totals of all parts: the counts of its tokens in all training documents,
    and how often its deleted documents' tokens have which estimates by counted documents."""
    texts, answers = group.slice(0, 1).to_pylist()[0], group.slice(1)
    chunk = Chunk(texts)
    end = int(chunk.word[-1])  # the last token of a text
    # the parts are ranges of the hashes, so their answers stand in the order of the sorted words and pairs
    word_counts, pair_counts = ([np.concatenate([unpack(a.as_py(), np.int64) for a in answers.column(f"p{at + i}")]) for i in (0, 1)] for at in (0, 2))
    chosen = np.flatnonzero(np.repeat(chunk.role == DELETED, chunk.lengths))
    if len(chosen):
        word, pair = chunk.word[chosen], chunk.pair[chosen]
        history = word_counts[0][before(chunk.word, chunk.lengths, end)[chosen]]
        two, one = ratio(pair_counts[0][pair], history), ratio(word_counts[0][word], np.full(len(word), counted_tokens))
        with np.errstate(divide="ignore"):
            steps = [np.where(p > 0, np.rint(np.log10(p) / STEP), 1).astype(np.int64) for p in (two, one)]
        key, n = np.unique(np.stack([bucket_of(history), *steps], axis=1), axis=0, return_counts=True)
        nothing = [pa.nulls(len(n), k) for k in (pa.int64(), pa.int32(), *[pa.binary()] * 6)]
        numbers = [pa.array(c, pa.int64()) for c in (*key.T, n)]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), ESTIMATE), pa.int32()), *nothing, *numbers], NAMES)
    one, two = sum(word_counts), sum(pair_counts)
    yield row(SUMS, texts["chunk"], packed=(texts["p0"], texts["p1"], texts["p2"], pack(one[chunk.word]), pack(two[chunk.pair])), numbers=(int(one[end]),))


def bucket_of(count: np.ndarray) -> np.ndarray:
    """0 for unseen histories, then one bucket per power of two."""
    return np.ceil(np.log2(count + 1.0)).astype(np.int64)


def ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def learn_weights(rows: list, vocabulary: int, rounds: int = 200) -> np.ndarray:
    """Weights (bigram, unigram, uniform) per bucket by expectation-maximisation.

    ``rows``: (bucket, step of the bigram estimate, step of the unigram estimate, tokens); a step of
    None stands for an estimate of 0. Buckets without tokens take the weights of all tokens together.
    """
    out = np.zeros((64, 3))
    if not rows:
        out[:] = (0.3, 0.5, 0.2)
        out[0] = (0.0, 0.7, 0.3)
        return out
    b = np.array([r[0] for r in rows])
    p = np.stack([[0.0 if r[i] is None else 10.0 ** (r[i] * STEP) for r in rows] for i in (1, 2)] + [np.full(len(rows), 1 / (vocabulary + 1))], axis=1)
    n = np.array([r[3] for r in rows], float)

    def mixed(chosen: np.ndarray) -> np.ndarray:
        w = np.full(3, 1 / 3)
        for _ in range(rounds):
            share = p[chosen] * w
            new = (n[chosen, None] * share / share.sum(axis=1, keepdims=True)).sum(axis=0) / n[chosen].sum()
            if np.abs(new - w).max() < 1e-7:
                break
            w = new
        w = np.maximum(w, 1e-6)  # no weight dies out
        return w / w.sum()

    out[:] = mixed(np.ones(len(b), bool))
    for k in np.unique(b):
        out[k] = mixed(b == k)
    out[0] = (0, out[0][0] + out[0][1], out[0][2])  # an unseen history has no bigram estimate
    return out


def score(docs: DataFrame, training: Column) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: one row per document.

    ``training`` is a condition on the documents that the model learns from. ``base_score`` is the add-half
    unigram model, ``score`` the interpolated one; both are log10 probabilities of the whole text and
    its end. A null text is empty: its end alone. Each row gives one row, repeated ids included.
    Without training documents every token is unknown. An empty table gives an empty result. Other
    columns are not read.
    """
    held = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(HELD_BACK)) == 0
    role = F.when(~training, TEST).when(held, DELETED).otherwise(COUNTED).cast("int").alias("role")
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).head()
    parts = max(LEAST_PARTS, -(-(size["bytes"] or 0) // PART_BYTES))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, at, held_tokens = TaskContext.get().partitionId() << 24, 0, 0
        ids, roles, texts = [], [], []
        for batch in batches:
            for i in range(batch.num_rows):
                ids.append(batch.column(0)[i].as_py())
                texts.append(tokens(batch.column(1)[i].as_py()))
                roles.append(batch.column(2)[i].as_py())
                held_tokens += len(texts[-1])
                if held_tokens >= CHUNK_TOKENS or len(ids) >= CHUNK_DOCS:
                    yield text_row(first + at, ids, roles, texts)
                    at, held_tokens, ids, roles, texts = at + 1, 0, [], [], []
        if ids:
            yield text_row(first + at, ids, roles, texts)

    table = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", role).mapInArrow(chunks, FIELDS), "tokens")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts in each_row(batches):
            yield from Chunk(texts).asked(texts["chunk"], parts)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in each_key(batches, ["part"]):
            yield from part_rows(group)

    in_parts = table.mapInArrow(ask, FIELDS).repartitionById(parts, F.col("part")).sortWithinPartitions("part")
    totals = settle(in_parts.mapInArrow(add_up, FIELDS), "totals")
    summed = totals.where(F.col("kind") == COUNTS).agg(*[F.coalesce(F.sum(f"n{i}"), F.lit(0)) for i in range(3)]).head()
    vocabulary, counted_tokens, all_tokens = summed[0], summed[1], summed[1] + summed[2]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in each_key(batches, ["chunk"]):
            yield from counted_rows(group, counted_tokens)

    both = table.unionByName(totals.where(F.col("kind") == TOTALS))
    met = settle(both.repartition(parts, F.col("chunk")).sortWithinPartitions("chunk", "part").mapInArrow(meet, FIELDS), "counted")
    discard(table, totals)
    found = met.where(F.col("kind") == ESTIMATE).groupBy("n0", "n1", "n2").agg(F.sum("n3").alias("n"))
    found = settle(found, "estimates")
    collected = found.collect()  # buckets x steps: a few ten thousand rows
    discard(found)
    weights = learn_weights([(r["n0"], None if r["n1"] > 0 else r["n1"], None if r["n2"] > 0 else r["n2"], r["n"]) for r in collected], vocabulary)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in each_row(batches):
            ids, missing, lengths = unpack(r["p0"], np.int64), unpack(r["p1"], np.uint8), unpack(r["p2"], np.int64)
            one, two = unpack(r["p3"], np.int64), unpack(r["p4"], np.int64)
            history, of = before(one, lengths, r["n0"]), np.repeat(np.arange(len(ids)), lengths)
            total = np.zeros((3, len(ids)))
            for start in range(0, len(one), TOKENS_AT_ONCE):
                c, h, pair, doc = (x[start : start + TOKENS_AT_ONCE] for x in (one, history, two, of))
                w = weights[bucket_of(h)]
                p = w[:, 0] * ratio(pair, h) + w[:, 1] * (c / max(1, all_tokens)) + w[:, 2] / (vocabulary + 1)
                base = (c + 0.5) / (all_tokens + 0.5 * (vocabulary + 1))
                low = doc[0]
                own = np.stack([np.bincount(doc - low, x) for x in (c > 0, np.log10(base), np.log10(p))])
                total[:, low : low + own.shape[1]] += own
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=missing > 0), pa.array(lengths), pa.array(total[0].astype(np.int64)), pa.array(total[1]), pa.array(total[2])],
                ["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    counted = met.where(F.col("kind") == SUMS).select("p0", "p1", "p2", "p3", "p4", "n0")
    out = settle(counted.mapInArrow(sums, "doc_id long, n_tokens long, n_known long, base_score double, score double"), "scores")
    discard(met)
    return out.withColumn("train_tokens", F.lit(all_tokens).cast("long"))
