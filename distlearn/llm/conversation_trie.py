"""The trie of all conversation prefixes, built shard by shard as double arrays.

A turn (role and text) is known by a 128-bit hash, a conversation by the hashes of its turns in order. Equal
conversations become one sequence with a number of members. Sequences that share a prefix go to one shard; where too many
share it, a prefix twice as long decides. Inside a shard turns get dense ids and the trie is packed into two arrays:
the child of node s by turn t is base[s] + t, and check of that place names s. Walking all sequences through them gives the
nodes. Nodes above the sharding prefix are shared by several shards and merged by Spark from each shard's share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import discard
from ..plans.skew import hot_join
from .common import each_key, settle

KEY = 16  # bytes that stand for a turn or a prefix
SHARD_TURNS = 20_000  # turns of different sequences that one double array holds
PIECE_BYTES = 1 << 20  # of a sorted list of members that travel as one row
TRIES = 64  # free places tried for the children of a node before the arrays grow
GROUP, REUSED = 5, 9  # conversations that share a start, and the remainder that says how much of it
NO_MEMBERS = hashlib.sha256(b"").hexdigest()


class DoubleArray:
    """A trie over sequences of dense turn ids: child(s, t) = base[s] + t, if check there is s. The root is place 0."""

    def __init__(self, turns: np.ndarray, lengths: np.ndarray):
        """``turns``: numbers of all sequences' turns one after another, any numbering; ``lengths``: turns of each."""
        self.base, self.check = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.used = 1  # places up to here hold nodes or gaps
        self.code = np.full(int(turns.max()) + 1 if len(turns) else 0, -1)  # dense id by number, given in the order of nodes: children lie close
        self.turns, self.lengths = turns, lengths
        self.starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64) if len(lengths) else np.zeros(0, np.int64)
        at, known, depth = np.zeros(len(lengths), np.int64), 0, 0
        while (going := np.flatnonzero(lengths > depth)).size:
            number = turns[self.starts[going] + depth]
            pairs, back = np.unique(np.stack([at[going], number]), axis=1, return_inverse=True)
            parent, number = pairs
            fresh, first = np.unique(number[self.code[number] < 0], return_index=True)
            self.code[fresh[np.argsort(first)]] = known + np.arange(len(fresh))
            known += len(fresh)
            at[going] = self._place(parent, self.code[number])[back.ravel()]
            depth += 1

    def _grow(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1)])
        self.used = max(self.used, size)

    def _place(self, parent: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Places for children, grouped by parent: families with several first, single ones into the gaps they leave."""
        place = np.empty(len(parent), np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1], [True]]))
        for a, b in zip(cuts[:-1], cuts[1:]):
            if b - a > 1:
                place[a:b] = self._fit(code[a:b])
                self.check[place[a:b]] = parent[a]
        single = cuts[:-1][np.diff(cuts) == 1]
        gaps = np.flatnonzero(self.check[: self.used] < 0)[: len(single)]
        end = self.used
        self._grow(end + len(single) - len(gaps))
        place[single] = np.concatenate([gaps, np.arange(end, end + len(single) - len(gaps))])
        self.check[place[single]] = parent[single]
        self.base[parent] = place - code
        return place

    def _fit(self, codes: np.ndarray) -> np.ndarray:
        """The first places where a family fits."""
        shape = codes - codes.min()
        gaps = np.flatnonzero(self.check[: self.used] < 0)[:TRIES] if len(codes) < self.used else np.zeros(0, np.int64)
        for place in gaps:
            wanted = place + shape
            inside = wanted[wanted < self.used]
            if (self.check[inside] < 0).all():
                self._grow(int(wanted.max()) + 1)
                return wanted
        wanted = self.used + shape
        self._grow(int(wanted.max()) + 1)
        return wanted

    def walk(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Depth by depth: the sequences that go on, their nodes, and where their turn lies in ``turns``."""
        at, depth = np.zeros(len(self.lengths), np.int64), 0
        while (going := np.flatnonzero(self.lengths > depth)).size:
            where = self.starts[going] + depth
            to = self.base[at[going]] + self.code[self.turns[where]]
            if (self.check[to] != at[going]).any():
                raise ValueError("a sequence leaves the trie")
            at[going] = to
            yield going, to, where
            depth += 1


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns, sizes): hashes and text bytes (64-bit) of each rebuilt conversation's turns, one row each.

    Turns are ordered by number, null first, equal numbers by hash. Conversation c starts with the first h turns of
    conversation c - c % 5, h = crc32 of c's digits modulo 9, and goes on with its own turns after its first h.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        (F.col("conv_id") - F.col("conv_id") % GROUP).alias("first"),
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").alias("turn"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % REUSED).cast("int").alias("reused"),
        F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("turn_key"),
        F.octet_length(text).cast("long").alias("size"),
    )
    order = ["first", F.col("conv_id") != F.col("first"), "conv_id", F.col("turn").asc_nulls_first(), "turn_key"]
    sent = rows.repartition("first").sortWithinPartitions(*order).select("first", "conv_id", "reused", "turn_key", "size")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = None, [], []  # the group at hand and the turns that its members may start with
        for conv in each_key(batches, ["conv_id"]):
            first, conv_id, reused = (conv.column(c)[0].as_py() for c in ("first", "conv_id", "reused"))
            keys, sizes = conv.column("turn_key").to_pylist(), conv.column("size").to_numpy()
            if conv_id == first:
                shared = first, keys[: REUSED - 1], sizes[: REUSED - 1]
            head, bytes_ = (shared[1][:reused], shared[2][:reused]) if shared[0] == first else ([], [])
            turns = b"".join(head) + b"".join(keys[reused:])
            yield pa.RecordBatch.from_pylist(
                [{"conv_id": conv_id, "turns": turns, "sizes": np.concatenate([bytes_, sizes[reused:]]).astype("<i8").tobytes()}]
            )

    return sent.mapInArrow(join, "conv_id long, turns binary, sizes binary")


def _members(ends: DataFrame) -> DataFrame:
    """(seq) with its number of conversations, the smallest, and the hash of all their ids in order.

    Ids are sorted over all tasks, also those of one sequence; its hash is then taken piece by piece, never holding them.
    """
    ordered = ends.repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in each_key(iter([batch]), ["seq"]):
                ids = part.column("conv_id").to_pylist()
                for at in range(0, len(ids), PIECE_BYTES // 20):
                    some = ids[at : at + PIECE_BYTES // 20]
                    row = {"seq": part.column("seq")[0].as_py(), "least": some[0], "n": len(some), "ids": ",".join(map(str, some)).encode()}
                    yield pa.RecordBatch.from_pylist([row], schema=PIECES)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for row in batch.to_pylist():
                if held is None or held["seq"] != row["seq"]:
                    if held is not None:
                        yield pa.RecordBatch.from_pylist([held | {"ends": sha.hexdigest()}], schema=MEMBERS)
                    held, sha = {"seq": row["seq"], "least": row["least"], "n": 0}, hashlib.sha256()
                elif held["n"]:
                    sha.update(b",")
                sha.update(row["ids"])
                held["n"] += row["n"]
        if held is not None:
            yield pa.RecordBatch.from_pylist([held | {"ends": sha.hexdigest()}], schema=MEMBERS)

    cut = ordered.mapInArrow(pieces, "seq binary, least long, n long, ids binary")
    return cut.repartition("seq").sortWithinPartitions("seq", "least").mapInArrow(hashes, "seq binary, least long, n long, ends string")


PIECES = pa.schema([("seq", pa.binary()), ("least", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
MEMBERS = pa.schema([("seq", pa.binary()), ("least", pa.int64()), ("n", pa.int64()), ("ends", pa.string())])


def _prefix(turns: int) -> Column:
    return F.unhex(F.md5(F.substring("turns", 1, KEY * turns)))


def _sharded(seqs: DataFrame, limit: int) -> DataFrame:
    """Add ``shard`` and ``cut``, the length of the prefix that decides it: 1 turn, or twice as many until few share it."""
    total, todo, done, cut = seqs.agg(F.sum(F.length("turns"))).head()[0] or 0, seqs, None, 1
    shards = max(1, -(-total // (KEY * limit)))
    while True:
        todo = todo.withColumn("prefix", _prefix(cut))
        counted = todo.groupBy("prefix").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.length("turns")).alias("_bytes"))
        hot = settle(counted.where(f"_n > 1 and _bytes > {KEY * limit}").select("prefix"), "hot_prefixes")
        some = not hot.isEmpty()
        calm = (todo.join(hot, "prefix", "left_anti") if some else todo).select("*", F.lit(cut).alias("cut"))
        done = calm if done is None else done.unionByName(calm)
        if not some:
            discard(hot)
            return done.withColumn("shard", F.pmod(F.xxhash64("prefix"), F.lit(shards))).drop("prefix")
        todo, cut = todo.join(hot, "prefix", "left_semi"), 2 * cut


def _numbered(keys: np.ndarray) -> np.ndarray:
    """Numbers of 128-bit keys (two columns), equal for equal keys."""
    order = np.lexsort((keys[:, 1], keys[:, 0]))
    new = np.concatenate([[False], (keys[order][1:] != keys[order][:-1]).any(axis=1)]) if len(keys) else np.zeros(0, bool)
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(new)
    return out


def _shard_nodes(part: pa.Table) -> Iterator[pa.RecordBatch]:
    """Nodes of one shard: those that it holds whole, and its share of those above the prefix that sharding went by."""
    turn_bytes = part.column("turns").to_pylist()
    lengths = np.array([len(t) // KEY for t in turn_bytes], np.int64)
    sizes = np.frombuffer(b"".join(part.column("sizes").to_pylist()), "<i8")
    n, least, cut = (part.column(c).to_numpy() for c in ("n", "least", "cut"))
    ends = part.column("ends").to_pylist()
    trie = DoubleArray(_numbered(np.frombuffer(b"".join(turn_bytes), "<u8").reshape(-1, 2)), lengths)
    room = trie.used
    members, smallest = np.zeros(room, np.int64), np.full(room, np.iinfo(np.int64).max)
    depth, size, seq = np.zeros(room, np.int64), np.zeros(room, np.int64), np.zeros(room, np.int64)
    members[0], smallest[0] = n.sum(), least.min()
    levels, last = [np.zeros(1, np.int64)], np.zeros(len(lengths), np.int64)
    for d, (going, to, where) in enumerate(trie.walk(), 1):
        np.add.at(members, to, n[going])
        np.minimum.at(smallest, to, least[going])
        depth[to], size[to], seq[to], last[going] = d, sizes[where], going, to
        levels.append(np.unique(to))
    whole = depth >= cut[seq]
    whole[0] = False
    children = np.zeros(room, np.int64)
    for level in levels[1:]:
        np.add.at(children, trie.check[level], 1)
    leaves, saved = (children == 0).astype(np.int64), (members - 1) * size
    for level in reversed(levels[1:]):
        inner = level[whole[level]]
        np.add.at(leaves, trie.check[inner], leaves[inner])
        np.add.at(saved, trie.check[inner], saved[inner])
    ended = np.full(room, -1)
    ended[last] = np.arange(len(lengths))
    nodes = np.concatenate(levels)
    parent = trie.check[nodes]
    kind = np.where(~whole[nodes], 2, np.where(whole[parent], 0, 1))  # inside the shard, next to the shared part, shared
    path = [
        [] if k == 0 else [hashlib.md5(turn_bytes[seq[v]][: KEY * i]).digest() for i in range(depth[v] + 1)] for v, k in zip(nodes.tolist(), kind.tolist())
    ]
    columns = {
        "kind": pa.array(kind, pa.int32()), "conv_id": smallest[nodes], "depth": depth[nodes],
        "parent_conv_id": pa.array(smallest[parent], mask=kind > 0), "n_convs": members[nodes], "n_children": children[nodes],
        "n_leaves": leaves[nodes], "saved_tokens": saved[nodes], "ends": pa.array([ends[i] if i >= 0 else None for i in ended[nodes]], pa.string()),
        "size": size[nodes], "path": pa.array(path, pa.list_(pa.binary())),
    }
    table = pa.table(columns)
    yield from table.to_batches(max_chunksize=5_000)


NODES = ("kind int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
         "ends string, size long, path array<binary>")
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty; turns without a conv_id belong to no conversation and are left out; repeated turns
    all count; turns of equal number are ordered by a hash of role and text. A table without turns gives no node, one with turns
    has the root (depth 0, no parent). Other columns play no part. A sequence travels as one row of 24 bytes a turn,
    texts of any length never do; a shard holds about ``shard_turns`` turns, more only if one sequence has more.
    """
    convs = settle(rebuilt(conversations).withColumn("seq", F.unhex(F.md5("turns"))), "conversations")
    ends = settle(_members(convs.select("seq", "conv_id")), "members")
    seqs = settle(convs.groupBy("seq").agg(F.max("turns").alias("turns"), F.max("sizes").alias("sizes")).join(ends, "seq"), "sequences")
    discard(convs, ends)
    sharded = _sharded(seqs, shard_turns).repartition("shard").sortWithinPartitions("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in each_key(batches, ["shard"]):
            yield from _shard_nodes(part)

    nodes = settle(sharded.select("shard", "turns", "sizes", "n", "least", "ends", "cut").mapInArrow(run, NODES), "nodes")
    discard(seqs)
    up, key = F.slice("path", 1, F.size("path") - 1), F.element_at("path", -1)
    tops = nodes.where("kind = 1").withColumns({"key": key, "parent": F.element_at("path", -2), "up": up})
    shared = settle(
        nodes.where("kind = 2").groupBy(key.alias("key")).agg(
            F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("path").alias("path"), F.sum("n_convs").alias("n_convs"),
            F.max("size").alias("size"), F.max("ends").alias("ends"),
        ).withColumns({"parent": F.when(F.col("depth") > 0, F.element_at(F.col("path"), F.greatest(F.col("depth").cast("int"), F.lit(1)))), "up": up}),
        "shared_nodes",
    )
    children = settle(
        tops.select("parent").unionByName(shared.where("depth > 0").select("parent")).groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children")), "children"
    )
    held = shared.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    gains = tops.select(F.explode("up").alias("key"), "n_leaves", "saved_tokens").unionByName(
        held.select(F.explode("path").alias("key"), (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"))
    )
    sums = gains.groupBy("key").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    above = settle(held.join(sums, "key").drop("path", "up"), "above")
    names = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"]
    below = tops.select(*names, "parent", "key").unionByName(above.where("depth > 0").select(*names, "parent", "key"))
    parents = above.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children").where("n_children > 0")
    parents = parents.withColumnRenamed("n_children", "_weight")
    met = hot_join(below, parents, "parent", "_weight", F.xxhash64("key"))
    found = nodes.where("kind = 0").select(*names, "parent_conv_id").unionByName(met.select(*names, "parent_conv_id"))
    found = found.unionByName(above.where("depth = 0").select(*names, F.lit(None).cast("long").alias("parent_conv_id")))
    return found.withColumn("ends_sha256", F.coalesce("ends", F.lit(NO_MEMBERS))).select(*RESULT)
