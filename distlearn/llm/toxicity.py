"""Toxicity by a support vector machine on a subsequence string kernel with Nystroem landmarks.

Words are compared by the letters they share in order, gaps allowed: the kernel sums over all
subsequences of three letters within a window, each gap shrinking their weight, so "idi-o.t",
"i d i o t" and "idxiot" stay close to "idiot". Landmarks are the words that labelled texts tie most
strongly to toxicity. A sentence is described by its largest kernel value with each landmark,
whitened by the kernel matrix of the landmarks (Nystroem); a linear machine with squared hinge loss
is trained on the labelled sentences and, with the same weight, on landmarks with a letter put in, and a document scores as its worst sentence, put on the scale of
a probability by a logistic curve over the same documents and disguised landmarks.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import discard
from .common import settle, whole_text

SAMPLE_DOCS = 20_000  # about so many labelled documents, drawn by a hash of the id, train the model
LEAST_DOCS = 4  # documents that a landmark occurs in
STRONGEST = 48  # words with the strongest z that small samples take as landmarks without proof
CHANCE = 0.01  # share of chance finds among the words tied to toxicity, at most
COVERED = 0.95  # a word this close to a landmark needs none of its own
ORDER_SPAN = 6  # letters that a subsequence may stretch over
DECAY = 0.85  # per letter in a gap
POWERS = (1, 8)  # the machine adds the kernel and a power of it: likeness, and near identity
FLOOR = 0.45  # smaller kernel values count as zero
THRESHOLD = 0.3
DISGUISED = 0.05  # weight of disguised landmarks in the curve, against that of the toxic documents found

SENTENCE = re.compile(r"[.!?]+(?=\s)|\n+")
SPACED = re.compile(r"(?<!\S)\S(?:\s+\S(?!\S)){2,}")  # letters set apart: i d i o t
NOT_LETTERS = re.compile(r"[\W_]+")
DIGIT = re.compile(r"\d")
DIGITS = str.maketrans("0134578", "oieastb")
REMEMBERED = 400_000  # words a Python worker keeps


def plain(word: str) -> str:
    """Letters of a lower-case word, of any script: accents and marks dropped, look-alike digits read as letters."""
    word = word.replace("@", "a")
    if not word.isascii():
        word = "".join(c for c in unicodedata.normalize("NFKD", word) if not unicodedata.combining(c))
    return DIGIT.sub("{", NOT_LETTERS.sub("", word).translate(DIGITS))


class Kernel:
    """Normalised gap-weighted kernel between words and a list of landmarks."""

    WORDS = 4096  # words looked up at once
    AT_ONCE = 1 << 18  # products summed at once
    TABLE = 1 << 24  # entries of the table of subsequences that landmarks have

    def __init__(self, landmarks: list[str], decay: float = DECAY, span: int = ORDER_SPAN, floor: float = FLOOR):
        self.landmarks, self.span, self.floor = landmarks, span, floor
        self.offsets = [(a, b, decay ** (b - 2)) for b in range(2, span) for a in range(1, b)]
        alphabet = sorted({c for w in landmarks for c in w})
        self.size = len(alphabet) + 1  # letters of landmarks; all others are 0, as no landmark can share them
        self.letter = np.zeros(0x110000, np.int32)
        self.letter[[ord(c) for c in alphabet]] = np.arange(1, self.size)
        owner, key, weight = self._summed(landmarks)
        self.codes, at = np.unique(key, return_inverse=True)
        norm = np.sqrt(np.bincount(owner, weight**2, minlength=len(landmarks)))
        order = np.argsort(at, kind="stable")  # for each subsequence the landmarks that have it, and their weights
        self.starts = np.searchsorted(at[order], np.arange(len(self.codes) + 1))
        self.owners, self.shares = owner[order], (weight / norm[owner])[order]
        # three letters index the table themselves unless the landmarks' alphabet is very large
        letters = [(self.codes >> s) & (2**21 - 1) for s in (42, 21, 0)]
        self.held = np.zeros(min(self.size**3, self.TABLE), bool)
        self.held[self._entry(*(self.letter[x].astype(np.int64) for x in letters))] = True

    def _entry(self, first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
        at = (first * self.size + second) * self.size + third
        return at if self.size**3 <= self.TABLE else at % self.TABLE

    def _met(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the subsequences that landmarks have, and their rows of the table."""
        if not len(self.codes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        found = np.flatnonzero(self.codes[row] == code)
        return found, row[found]

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Code points of all words, apart from each other (0), and the word of each."""
        gap = "\0" * (self.span - 1)
        flat = np.frombuffer((gap.join(words) + gap).encode("utf-32-le"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(len(words)), [len(w) + len(gap) for w in words])
        return flat, owner

    def _shared(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each word's weight on subsequences that landmarks have, and in all."""
        flat, owner = self._letters(words)
        letter = self.letter[flat].astype(np.int64)
        first, second = letter * self.size**2, letter * self.size
        direct = self.size**3 <= self.TABLE
        lengths = np.array([len(w) for w in words])
        shared, own = np.zeros(len(words)), np.zeros(len(words))
        for a, b, weight in self.offsets:
            at = first[: len(flat) - b] + second[a : len(flat) - b + a] + letter[b:]
            hit = np.flatnonzero(self.held[at if direct else at % self.TABLE])
            if not direct:  # entries may coincide
                code = (flat[hit] << 42) | (flat[hit + a] << 21) | flat[hit + b]
                hit = hit[self._met(code)[0]]
            shared += np.bincount(owner[hit], minlength=len(words)) * weight**2
            own += np.maximum(lengths - b, 0) * weight**2
        return shared, own

    def _summed(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, subsequence, summed weight), once for each subsequence of a word."""
        flat, owner = self._letters(words)
        points, local = np.unique(flat, return_inverse=True)
        n = len(points)
        keys, weights = [], []
        for a, b, weight in self.offsets:  # every placement of three letters
            first, third = flat[: len(flat) - b], flat[b:]
            at = np.flatnonzero((first > 0) & (third > 0))
            keys.append(((owner[at] * n + local[at]) * n + local[at + a]) * n + local[at + b])
            weights.append(np.full(len(at), weight))
        key, weight = np.concatenate(keys), np.concatenate(weights)
        key, at = np.unique(key, return_inverse=True)
        third, second, first = points[key % n], points[key // n % n], points[key // n**2 % n]
        return key // n**3, (first << 42) | (second << 21) | third, np.bincount(at, weight, minlength=len(key))

    def values(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(indices of words close to a landmark, their kernel values with each landmark).

        A word can only be close if enough of its own weight lies on subsequences that landmarks
        have, which one table tells; the others are done with.
        """
        none = np.zeros(0, np.int64), np.zeros((0, len(self.landmarks)), np.float32)
        if not words or not self.landmarks:
            return none
        if len(words) > self.WORDS:
            parts = [(start, *self.values(words[start : start + self.WORDS])) for start in range(0, len(words), self.WORDS)]
            return np.concatenate([start + at for start, at, _ in parts]), np.concatenate([v for _, _, v in parts])
        shared, own = self._shared(words)
        near = np.flatnonzero((shared >= self.floor**2 * own) & (shared > 0))
        if not len(near):
            return none
        word, code, weight = self._summed([words[i] for i in near])
        norm = np.sqrt(np.bincount(word, weight**2, minlength=len(near)))
        out = np.zeros((len(near), len(self.landmarks)), np.float32)
        hit, row = self._met(code)
        counts = self.starts[row + 1] - self.starts[row]  # landmarks that have the subsequence
        ends = np.cumsum(counts)
        cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] if len(ends) else 0, self.AT_ONCE)))
        for a, b in zip(cuts, [*cuts[1:], len(hit)]):
            n, low = counts[a:b], word[hit[a]]
            entry = np.repeat(self.starts[row[a:b]] - (ends[a:b] - n), n) + np.arange(ends[a] - counts[a], ends[b - 1])
            cell = np.repeat(word[hit[a:b]] - low, n) * len(self.landmarks) + self.owners[entry]
            rows = word[hit[b - 1]] - low + 1
            summed = np.bincount(cell, np.repeat(weight[hit[a:b]], n) * self.shares[entry], minlength=rows * len(self.landmarks))
            out[low : low + rows] += summed.reshape(rows, -1)
        out /= norm[:, None]
        out[out < self.floor] = 0
        found = out.any(axis=1)
        return near[found], out[found]


class Reader:
    """Kernel values of sentences; words met before are remembered."""

    def __init__(self, kernel: Kernel):
        self.kernel = kernel
        self.seen: set[str] = set()
        self.close: dict[str, np.ndarray] = {}
        self.seen_before: set[str] = set()  # words of the memory that was set aside last
        self.close_before: dict[str, np.ndarray] = {}

    def learn(self, words: set[str]) -> None:
        new = words - self.seen
        if len(self.seen) > REMEMBERED:
            self.seen_before, self.close_before, self.seen, self.close, new = self.seen, self.close, set(), {}, words
        self.seen.update(new)
        known = new & self.seen_before
        self.close.update((w, self.close_before[w]) for w in known & self.close_before.keys())
        new = list(new - known)
        for start in range(0, len(new), 20_000):
            part = new[start : start + 20_000]
            at, values = self.kernel.values([plain(w) for w in part])
            self.close.update(zip((part[i] for i in at), values))

    def sentences(self, texts: list[str]) -> list[list[np.ndarray]]:
        """Per text, the kernel values of each sentence that is close to a landmark."""
        lower = [t.lower() for t in texts]
        spaced = [["".join(m.split()) for m in SPACED.findall(t)] for t in lower]
        words = [set(t.split()) for t in lower]
        for w, s in zip(words, spaced):
            w.update(s)
        self.learn(set().union(*words))
        out = []
        for text, own in zip(lower, words):
            if self.close.keys().isdisjoint(own):
                out.append([])
                continue
            found = []
            for sentence in SENTENCE.split(text):
                held = [v for w in (*sentence.split(), *("".join(m.split()) for m in SPACED.findall(sentence))) if (v := self.close.get(w)) is not None]
                if held:
                    found.append(np.max(held, axis=0))
            out.append(found)
        return out


def powers(values: np.ndarray) -> np.ndarray:
    """Kernel values and their powers, side by side."""
    return np.concatenate([values.astype(float) ** p for p in POWERS], axis=-1)


@dataclass
class Toxicity:
    """A trained model: ``score`` = logistic(slope * worst sentence + shift)."""

    landmarks: list[str] = field(default_factory=list)
    alpha: list[float] = field(default_factory=list)
    bias: float = 0.0
    slope: float = 0.0
    shift: float = 0.0

    def scores(self, reader: Reader, texts: list[str]) -> np.ndarray:
        alpha = np.array(self.alpha)
        worst = [max([self.bias, *(self.bias + float(powers(s) @ alpha) for s in found)]) for found in reader.sentences(texts)]
        return 1 / (1 + np.exp(-(self.slope * np.array(worst) + self.shift)))


def small_batches(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column, size: int = SAMPLE_DOCS) -> DataFrame:
    """(text, toxic) of about ``size`` labelled documents at most, one row per different text.

    Labels of one document are joined by their maximum; null labels are left out. The labels drawn
    (about ``size`` rows of two numbers) are all that is broadcast.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(usable).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = settle(known, "labels")
    parts = max(1, -(-known.count() // size))
    drawn = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == 0)
    met = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(drawn), "doc_id")
    texts = met.groupBy(F.xxhash64("text").alias("_hash")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic")).drop("_hash")
    out = settle(texts, "labelled")
    discard(known)
    return out


def covering(words: list[str]) -> list[str]:
    """The words without those that are close to an earlier one."""
    out: list[str] = []
    kernel, close = Kernel(words, floor=0.0), np.zeros((len(words), len(words)), bool)
    for start in range(0, len(words), 256):
        at, values = kernel.values(words[start : start + 256])
        close[start + at] = values >= COVERED
    taken = np.zeros(len(words), bool)
    for i, word in enumerate(words):
        if not close[i, taken].any():
            taken[i] = True
            out.append(word)
    return out


def choose_landmarks(sample: DataFrame) -> list[str]:
    """The words tied to toxic texts beyond chance, strongest evidence first, as far as others don't cover them.

    Evidence is the Chernoff bound on the chance of so many toxic texts among the word's; which words pass
    follows from CHANCE and the number of words by Benjamini and Hochberg, not from the strongest word. As small
    samples prove little, the STRONGEST words by z are added, as far as z is above 3 and half the strongest.
    Near copies share words and labels, which is no evidence: of the words that pass, each pair of neighbours
    (of the first occurrence in a text) counts once, and the words must pass again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, bad = Counter(), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = {p for w in set(text.lower().split()) if 3 <= len(p := plain(w)) <= 40}
                texts.update(words)
                if toxic:
                    bad.update(words)
        words = list(texts)
        yield pa.RecordBatch.from_pydict(
            {"word": pa.array(words, pa.string()), "n": pa.array([texts[w] for w in words], pa.int64()), "t": pa.array([bad[w] for w in words], pa.int64())}
        )

    rate = sample.agg(F.avg(F.col("toxic").cast("double"))).head()[0] or 0.0
    if not 0 < rate < 1:
        return []
    n, t = F.col("n"), F.col("t")
    share = t / n
    evidence = F.when(t > 0, t * F.log(share / rate)).otherwise(0.0) + F.when(t < n, (n - t) * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    counted = sample.select("text", "toxic").mapInArrow(run, "word string, n long, t long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    tested = settle(counted.where(n >= LEAST_DOCS), "tested")
    words = tested.count()
    found = tested.where(share > rate).select("word", evidence.alias("e")).where(F.col("e") >= float(np.log(1 / CHANCE))).orderBy(F.desc("e"), "word").collect()
    z = (t - n * rate) / F.sqrt(n * (rate * (1 - rate)))
    top = tested.withColumn("z", z).where("z > 3").orderBy(F.desc("z"), "word").limit(STRONGEST).collect()
    discard(tested)
    passed = [i for i, r in enumerate(found, 1) if r["e"] >= np.log(words / (CHANCE * i))]
    likely = {r["word"] for r in found[: max(passed, default=0)]}

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[str, str] = {}
        for batch in batches:
            rows = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts, met = text.lower().split(), set()
                for i, w in enumerate(parts):
                    p = read.get(w)
                    if p is None:
                        p = read[w] = plain(w)
                    if p in likely and p not in met:
                        met.add(p)
                        rows.append((p, " ".join([*parts[max(0, i - 1) : i], "", *parts[i + 1 : i + 2]]), int(toxic or 0)))
            if len(read) > REMEMBERED:
                read = {}
            yield pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in rows], kind) for i, (k, kind) in enumerate((("word", pa.string()), ("beside", pa.string()), ("toxic", pa.int32())))})

    once = sample.select("text", "toxic").mapInArrow(neighbours, "word string, beside string, toxic int").groupBy("word", "beside").agg(F.min("toxic").alias("toxic"))
    again = once.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("t")).where(share > rate)
    again = again.select("word", evidence.alias("e")).orderBy(F.desc("e"), "word").collect() if likely else []
    passed = [i for i, r in enumerate(again, 1) if r["e"] >= np.log(words / (CHANCE * i))]
    proven = [r["word"] for r in again[: max(passed, default=0)]]
    return covering(list(dict.fromkeys([*proven, *(r["word"] for r in top if r["z"] >= top[0]["z"] / 2)])))


def disguised(word: str) -> list[str]:
    """The word with one letter put in or doubled, at each place."""
    return [word[:i] + c + word[i:] for i in range(1, len(word)) for c in ("x", word[i])]


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 1.0) -> np.ndarray:
    """Linear machine with squared hinge loss by Newton steps, summed over blocks of rows; the last column of x is 1, for the bias."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(50):
        bend, slope = ridge.copy(), ridge @ w
        for i in range(0, len(x), 2048):
            rows = x[i : i + 2048]
            margin = 1 - y[i : i + 2048] * (rows @ w)
            on = margin > 0
            rows = rows[on]
            a = rows * (weight[i : i + 2048][on] * cost)[:, None]
            bend += a.T @ rows
            slope -= a.T @ (y[i : i + 2048][on] * margin[on])
        step = np.linalg.solve(bend, slope)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def logistic_curve(value: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (not negative) and shift of the curve through labels, targets drawn in as Platt has it."""
    positive, negative = weight[y > 0].sum(), weight[y == 0].sum()
    target = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    x = np.stack([value, np.ones(len(value))], axis=1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(bend, x.T @ (weight * (p - target)) + 1e-3 * w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(0.0, float(w[0])), float(w[1])


def train(docs: DataFrame, labels: DataFrame, usable: Column, size: int = SAMPLE_DOCS) -> Toxicity:
    """A model from the labelled documents for which ``usable`` (a condition on doc_id) holds.

    Without labels of both kinds, or without a word that tells them apart, every text scores alike:
    the share of toxic labels (1/2 without labels).
    """
    sample = labelled_sample(docs, labels, usable, size)
    landmarks = choose_landmarks(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Kernel(landmarks))
        for batch in batches:
            for part in small_batches(batch):
                texts, toxic = part.column(0).to_pylist(), part.column(1).to_pylist()
                found = reader.sentences(texts)
                yield pa.RecordBatch.from_pydict(
                    {
                        "toxic": pa.array(toxic, pa.int32()),
                        "others": pa.array([len(SENTENCE.split(t)) - len(f) for t, f in zip(texts, found)], pa.int64()),
                        "near": pa.array([np.array(f, np.float32).tobytes() for f in found], pa.binary()),
                    }
                )

    rows = sample.select("text", F.col("toxic").cast("int")).mapInArrow(run, "toxic int, others long, near binary").collect()
    discard(sample)
    y = np.array([1 if r["toxic"] else 0 for r in rows], float)
    if not landmarks or not 0 < y.sum() < len(y):
        rate = (y.sum() + 1) / (len(y) + 2)
        return Toxicity(shift=float(np.log(rate / (1 - rate))))
    near = [np.frombuffer(r["near"], np.float32).reshape(-1, len(landmarks)) for r in rows]
    kernel = Kernel(landmarks, floor=0.0)
    gram = np.zeros((len(landmarks), len(landmarks)))
    at, values = kernel.values(landmarks)
    gram[at] = values
    gram = (gram + gram.T) / 2
    whiten = np.zeros((len(POWERS) * len(gram), len(POWERS) * len(gram)))
    for i, p in enumerate(POWERS):
        value, vector = np.linalg.eigh(gram**p)
        block = slice(i * len(gram), (i + 1) * len(gram))
        whiten[block, block] = vector @ np.diag(np.maximum(value, 1e-3) ** -0.5) @ vector.T
    others = np.array([r["others"] for r in rows], float)
    at, altered = Kernel(landmarks).values([v for word in landmarks for v in disguised(word)])
    x = np.ones((sum(map(len, near)) + len(at) + 2, len(whiten) + 1))  # one row a suspicious sentence, a disguised landmark, and two for all others
    filled = 0
    for block in (*near, *(altered[i : i + 2048] for i in range(0, len(altered), 2048))):
        x[filled : filled + len(block), :-1] = powers(block) @ whiten
        filled += len(block)
    x[filled:, :-1] = 0
    of_sentence = np.repeat(y, [len(n) for n in near])
    sign = np.concatenate([2 * of_sentence - 1, np.ones(len(at)), [1.0, -1.0]])
    share = of_sentence.sum() / max(1, len(at))
    weight = np.concatenate([np.ones(len(of_sentence)), np.full(len(at), share), [others[y > 0].sum(), others[y == 0].sum()]])
    w = machine(x, sign, weight)
    alpha, bias = whiten @ w[:-1], float(w[-1])
    worst = np.array([max([bias, *(bias + powers(n) @ alpha)]) for n in near])
    known = np.array([len(n) > 0 for n in near]) & (y > 0)  # toxic documents with a suspicious sentence
    slope, shift = logistic_curve(
        np.concatenate([worst, bias + powers(altered) @ alpha]),
        np.concatenate([y, np.ones(len(at))]),
        np.concatenate([np.ones(len(y)), np.full(len(at), DISGUISED * known.sum() / max(1, len(at)))]),
    )
    return Toxicity(landmarks, alpha.tolist(), bias, slope, shift)


def score(docs: DataFrame, model: Toxicity) -> DataFrame:
    """All columns of ``docs`` and ``toxicity`` (0 to 1), in one pass without a shuffle.

    A null or empty text scores like a text without a suspicious word. Repeated rows score alike; an
    empty table gives an empty result. A column called ``toxicity`` is replaced.
    """
    kept = docs.drop("toxicity")
    at = kept.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(Kernel(model.landmarks))
        for batch in batches:
            for part in small_batches(batch):
                scores = model.scores(reader, [t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], [*part.schema.names, "toxicity"])

    schema = T.StructType([*kept.schema.fields, T.StructField("toxicity", T.DoubleType())])
    return kept.mapInArrow(run, schema)
