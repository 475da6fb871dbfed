"""Counting tokens with a tokenizer that is compiled to a finite-state transducer.

The tokenizer (a ``tokenizers`` file: lower case, split by character class, byte-pair merges with word ends)
becomes one deterministic transducer over characters. Its state holds where the splitter stands and,
inside a word, every vocabulary entry that may still end: the place in the trie of tokens, the token before
it, and how many tokens stand there more or less than at the prefix read so far. Each transition is annotated
with the tokens it adds to the count. States and transitions are compiled when a text first needs them.

Longer texts are cut into chunks. A chunk's state map says where each entry state leads and at which count.
A space or an ASCII digit ends every word whatever the state, so the map is the text before the first of them (the only
part whose count depends on the entry state), a constant, and the state after the last one, given by the text
that leads there. Maps compose associatively, so Spark folds them in a tree over all chunks of all texts.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer, normalizers

from ..plans.lineage import discard
from ..plans.skew import hot_join
from .common import each_key, settle

CHUNK_CHARS = 1 << 16
FAN = 256  # state maps that one step folds into one
STATES = 200_000  # compiled states that a Python worker holds; then it starts anew
WORD_END = 256  # added to the last byte of a word
OUT, LETTERS, OTHER, QUOTE, QUOTE_LETTER = range(5)  # where the splitter stands; the last two after an apostrophe that starts a match
SHORT_ENDINGS, LONG_ENDINGS = "stmd", {"r": "e", "v": "e", "l": "l"}  # 's 't 'm 'd, and 're 've 'll
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # the only way to split that is compiled here
RESET = re.compile(r"[ \t-\r0-9]")  # a word never reaches across these, and no character composes with them


class Merges:
    """Byte-pair merges as a trie of tokens and the rule which tokens may stand side by side."""

    def __init__(self, vocab: dict[str, int], merges: list[list[str]], letters: dict[int, str], end: str):
        self.rank: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        spelled: dict[int, tuple[int, ...]] = {}
        for byte, letter in letters.items():
            for symbol, name in ((byte, letter), (byte + WORD_END, letter + end)):
                spelled[vocab[name]] = (symbol,)
                self.rank[vocab[name]] = -1
        for rank, (a, b) in enumerate(merges):
            token, pair = vocab[a + b], (vocab[a], vocab[b])
            self.pairs[pair] = rank
            self.rank[token], self.halves[token], spelled[token] = rank, pair, spelled[pair[0]] + spelled[pair[1]]
        self.root: dict = {}
        whole = set()  # tokens that merging their own bytes gives; no others occur. Halves come before what they make
        for token, symbols in spelled.items():
            half = self.halves.get(token)
            if half is None or (half[0] in whole and half[1] in whole and self.stands(*half, self.rank[token])):
                whole.add(token)
                node = self.root
                for s in symbols:
                    node = node.setdefault(s, {})
                node[None] = token
        self.known: dict[tuple[int, int], bool] = {}

    def stands(self, left: int, right: int, below: float = float("inf")) -> bool:
        """True if no merge of rank < ``below`` would have joined bytes across the border of the two tokens.

        Their merges are undone from the last one; a merge across counts if it comes before the one undone next.
        """
        rank = self.rank
        while True:
            across = self.pairs.get((left, right))
            if across is not None and across < below:
                return False
            a, b = rank[left], rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                left, below = self.halves[left][1], min(below, a)
            else:  # of equal ranks the merge further left comes first
                right, below = self.halves[right][0], min(below, b + 1)

    def fits(self, left: int, right: int) -> bool:
        found = self.known.get((left, right))
        if found is None:
            if len(self.known) > 1_000_000:
                self.known.clear()
            found = self.known[left, right] = self.stands(left, right)
        return found


Open = tuple[tuple, ...]  # (node id, token before it, tokens up to there minus tokens of the prefix), ...


class Transducer:
    """The compiled tokenizer; ``count`` runs it over a text."""

    def __init__(self, definition: str):
        spec = json.loads(definition)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if split["pattern"].get("Regex") != PATTERN or kinds != ["NFC", "Replace", "Lowercase"] or spec.get("post_processor"):
            raise ValueError("only lower-casing word BPE tokenizers are compiled")
        self.library = Tokenizer.from_str(definition)
        self.nfc = normalizers.NFC()
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in printable]
        letters = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.merges = Merges(model["vocab"], model["merges"], letters, model["end_of_word_suffix"])
        self.nodes: list[dict] = [self.merges.root]  # trie nodes by number; a node keeps its number under -1
        self.parts: dict[str, list[tuple[str, str, bytes]]] = {}
        self.table: dict[tuple, dict] = {}
        self.start = self._row((OUT, (), 0))

    # ------------------------------------------------ words

    def _read(self, opened: Open, byte: int) -> tuple[Open, int, int]:
        """Read a byte of a word: the entries open now, and by how much the number of tokens changes if the word goes on and if it ends."""
        going, token, now, last = [], None, 0, None
        for at, before, tokens in opened:
            here = self.nodes[at]
            ended = here.get(byte + WORD_END)
            if last is None and ended is not None and (before < 0 or self.merges.fits(before, ended[None])):
                last = tokens + 1
            node = here.get(byte)
            if node is None:
                continue
            ended = node.get(None)
            if token is None and ended is not None and (before < 0 or self.merges.fits(before, ended)):
                token, now = ended, tokens + 1
            if len(node) > (None in node) + (-1 in node):
                if -1 not in node:
                    node[-1] = len(self.nodes)
                    self.nodes.append(node)
                going.append((node[-1], before, tokens))
        if token is None or last is None:
            raise ValueError(f"no token ends with byte {byte}")
        return (*((n, b, t - now) for n, b, t in going), (0, token, 0)), now, last

    def _begin(self, mode: int, data: bytes) -> tuple[tuple, int]:
        return self._extend((mode, ((0, -1, 0),), 0), data)

    def _extend(self, state: tuple, data: bytes) -> tuple[tuple, int]:
        """Read bytes of a word. The state also holds what the count gains if the last one ends the word."""
        mode, opened, end = state
        n = 0
        for byte in data:
            opened, now, last = self._read(opened, byte)
            n, end = n + now, last - now
        return (mode, opened, end), n

    def _word(self, text: str) -> int:
        state, n = self._begin(OTHER, text.encode())
        return n + state[2]

    # ------------------------------------------------ characters

    def _classes(self, ch: str) -> list[tuple[str, str, bytes]]:
        """(class, character, bytes) of a character's normal form, as the tokenizer's own parts tell."""
        found = self.parts.get(ch)
        if found is None:
            cut = lambda s: len(self.library.pre_tokenizer.pre_tokenize_str(s))
            found = []
            for c in self.library.normalizer.normalize_str(ch):
                twice = cut(c + c)
                found.append((("space", "letter" if cut(c + "a") == 1 else "other", "digit")[twice], c, c.encode()))
            self.parts[ch] = found
        return found

    def _step(self, state: tuple, kind: str, c: str, data: bytes) -> tuple[tuple, int]:
        mode, n = state[0], 0
        if mode == QUOTE:
            if c in SHORT_ENDINGS:
                return (OUT, (), 0), self._word("'" + c)
            if c in LONG_ENDINGS:
                return (QUOTE_LETTER, c, 0), 0
            state, n = self._begin(OTHER, b"'")
        elif mode == QUOTE_LETTER:
            first = state[1]
            if LONG_ENDINGS[first] == c:
                return (OUT, (), 0), self._word("'" + first + c)
            n = self._word("'")
            state, more = self._begin(LETTERS, first.encode())
            n += more
        mode = state[0]
        if (mode == LETTERS and kind == "letter") or (mode == OTHER and kind == "other"):
            state, more = self._extend(state, data)
            return state, n + more
        if mode != OUT:
            n += state[2]
        if kind == "space":
            return (OUT, (), 0), n
        if kind == "digit":
            return (OUT, (), 0), n + self._word(c)
        if c == "'":
            return (QUOTE, (), 0), n
        state, more = self._begin(LETTERS if kind == "letter" else OTHER, data)
        return state, n + more

    def _finish(self, state: tuple) -> int:
        mode = state[0]
        if mode == OUT:
            return 0
        if mode == QUOTE:
            return self._word("'")
        if mode == QUOTE_LETTER:
            return self._word("'") + self._word(state[1])
        return state[2]

    def _row(self, state: tuple) -> dict:
        row = self.table.get(state)
        if row is None:
            row = self.table[state] = {None: state}
        return row

    def _compile(self, row: dict, ch: str) -> tuple[dict, int]:
        """The transition of ``row`` on a character, or its end for an empty one."""
        state, n = row[None], 0
        if ch:
            for part in self._classes(ch):
                state, more = self._step(state, *part)
                n += more
        else:
            n, state = self._finish(state), (OUT, (), 0)
        if len(self.table) > STATES:
            for old in self.table.values():  # rows name each other
                old.clear()
            self.table.clear()
            self.merges.known.clear()
            self.start = self._row((OUT, (), 0))
            return self._row(state), n
        row[ch] = found = (self._row(state), n)
        return found

    def _plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = self.nfc.normalize_str(text)
        row, total = self.start, 0
        for ch in text:
            hit = row.get(ch)
            if hit is None:
                hit = self._compile(row, ch)
            row, n = hit
            total += n
        hit = row.get("")
        return total + (self._compile(row, "") if hit is None else hit)[1]

    def count(self, text: str) -> int:
        """Tokens of a text; strings of the special tokens are one token each, as the library reads them."""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        return sum(map(self._plain, self.special.split(text))) + len(self.special.findall(text))

    # ------------------------------------------------ state maps

    def state_map(self, text: str) -> tuple[str, int, str, bool]:
        """(head, count, tail, resets) of a chunk; without a reset all of it is head."""
        first = RESET.search(text)
        if first is None:
            return text, 0, "", False
        last = next(i for i in range(len(text) - 1, -1, -1) if RESET.match(text, i))
        return text[: first.start()], self.count(text[first.start() : last + 1]), text[last + 1 :], True

    def compose(self, maps: list[tuple[str, int, str, bool]]) -> tuple[str, int, str, bool]:
        """The map of chunks that follow each other; pieces of a word that many chunks share are joined once."""
        head, total, tail, resets = [], 0, [], False
        for h, n, t, r in maps:
            (tail if resets else head).append(h)
            if r:
                if resets:
                    total += self.count("".join(tail))
                total, tail, resets = total + n, [t], True
        return "".join(head), total, "".join(tail), resets


_TRANSDUCERS: dict[int, Transducer] = {}  # of this Python worker, the one used last


def transducer(definition: str) -> Transducer:
    key = hash(definition)
    if key not in _TRANSDUCERS:
        _TRANSDUCERS.clear()
        _TRANSDUCERS[key] = Transducer(definition)
    return _TRANSDUCERS[key]


def count_tokens(docs: DataFrame, path: str, text_col: str = "text", chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """All columns of ``docs`` but the text, and n_bytes (of the text in UTF-8) and n_tokens.

    A null or empty text has no bytes and no tokens. Every row gives one row, also repeated ones and those without an
    id; an empty table gives none; columns called n_bytes or n_tokens are replaced, all others, of any type, kept.
    Texts of up to ``chunk_chars`` characters are one chunk and counted where they are read, without a shuffle. Different
    longer ones are cut, their chunks counted in any task, and the state maps folded FAN at a time; equal texts are counted once.
    The file (2 MB) is read by the driver and broadcast.
    """
    with open(path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    names = [c for c in docs.columns if c not in (text_col, "n_bytes", "n_tokens")]
    kept = F.struct(*[F.col(f"`{c}`") for c in names], F.lit(0).alias("n_bytes"))  # one column, so that no name can clash
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(kept.alias("kept"), text.alias("text")).withColumn("bytes", F.octet_length("text").cast("long"))
    is_long = F.char_length("text") > chunk_chars
    counts = [T.StructField("bytes", T.LongType()), T.StructField("tokens", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(shared.value)
        for batch in batches:
            n = pa.array([t.count(x) for x in batch.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("kept"), batch.column("bytes"), n], ["kept", "bytes", "tokens"])

    def named(found: DataFrame) -> DataFrame:
        return found.select(*[F.col(f"kept.`{c}`") for c in names], F.col("bytes").alias("n_bytes"), F.col("tokens").alias("n_tokens"))

    counted = named(rows.where(~is_long).mapInArrow(run, T.StructType([rows.schema["kept"], *counts])))
    longs = settle(rows.where(is_long).withColumns({"sha": F.sha2("text", 256), "at": F.monotonically_increasing_id()}), "long_texts")
    longest = longs.agg(F.max(F.char_length("text"))).head()[0]
    if longest is None:
        discard(longs)
        return counted
    texts = longs.groupBy("sha").agg(F.max("text").alias("text"), F.count(F.lit(1)).alias("n"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sha, n, text in zip(*(batch.column(c).to_pylist() for c in ("sha", "n", "text"))):
                for k, at in enumerate(range(0, len(text), chunk_chars)):
                    yield pa.RecordBatch.from_pylist([{"sha": sha, "n": n, "k": k, "chunk": text[at : at + chunk_chars]}])

    def map_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(shared.value)
        for batch in batches:
            maps = [t.state_map(x) for x in batch.column("chunk").to_pylist()]
            if maps:
                columns = [pa.array(list(c), kind) for c, kind in zip(zip(*maps), (pa.string(), pa.int64(), pa.string(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([batch.column("sha"), batch.column("n"), batch.column("k"), *columns], MAP_NAMES)

    def fold_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(shared.value)
        for part in each_key(batches, ["sha", "g"]):
            head, total, tail, resets = t.compose(list(zip(*(part.column(c).to_pylist() for c in ("head", "total", "tail", "resets")))))
            first = part.slice(0, 1).to_pylist()[0]
            yield pa.RecordBatch.from_pylist(
                [{"sha": first["sha"], "n": first["n"], "k": first["g"], "head": head, "total": total, "tail": tail, "resets": resets}]
            )

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = transducer(shared.value)
        for batch in batches:
            ends = zip(*(batch.column(c).to_pylist() for c in ("head", "total", "tail")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("sha"), batch.column("n"), pa.array([t.count(h) + n + t.count(e) for h, n, e in ends], pa.int64())], ["sha", "n", "tokens"]
            )

    chunks = texts.select("sha", "n", "text").mapInArrow(cut, "sha string, n long, k long, chunk string").repartition("sha", "k")
    maps, left = chunks.mapInArrow(map_chunks, MAP_SCHEMA), -(-longest // chunk_chars)
    while left > 1:
        grouped = maps.withColumn("g", F.floor(F.col("k") / FAN).cast("long")).repartition("sha", "g").sortWithinPartitions("sha", "g", "k")
        maps, left = grouped.mapInArrow(fold_maps, MAP_SCHEMA), -(-left // FAN)
    totals = settle(maps.mapInArrow(close, "sha string, n long, tokens long"), "long_counts")
    return counted.unionByName(named(hot_join(longs.select("kept", "sha", "bytes", "at"), totals, "sha", "n", F.col("at"))))


MAP_NAMES = ["sha", "n", "k", "head", "total", "tail", "resets"]
MAP_SCHEMA = "sha string, n long, k long, head string, total long, tail string, resets boolean"
