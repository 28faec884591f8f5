"""Conversation prefix trie: every distinct sequence of first turns is a node, with counts rolled up over its subtree.

Conversations become chains of hashes in one streaming pass; equal prefixes are then equal keys. Nodes with the same members (a run down one
path) make one edge of a compressed trie, so a trie has at most two edges a conversation, however long they are. Shards of whole subtrees are
built as LOUDS tries in numpy and rolled up from the last level to the first; what stands above the shards is merged on its own.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import materialize

#: A node of more conversations than this, or than the square root of all turns if that is more, stands above the shards. A shard has this many
#: conversations in the mean and at most about two such subtrees' worth; n turns leave at most n / LIGHT nodes above.
LIGHT = 1_000
#: More heavy nodes than this are joined by a shuffle.
BROADCAST_NODES = 100_000
#: Characters of a text by which turns of one number and role are ordered; after them by hash.
TIE_CHARS = 32
#: The stand-in for a null conv_id, which is the least.
NO_ID = -(2**63)
PATHS = "conv_id long, depth int, k1 long, k2 long, p1 long, p2 long, words long, cum long, ends boolean"


def _turns(turns: DataFrame, share: int | None) -> DataFrame:
    """Turns without their texts: a hash of role and text, the number of words, and what they are ordered by. Those that share come together."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    conv = F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_ID))
    block = F.when(F.col("conv_id").isNull(), F.lit(NO_ID)).otherwise(conv - F.pmod(conv, F.lit(share))) if share else conv
    return turns.select(
        block.alias("block"), conv.alias("conv_id"), "turn", role.alias("role"), F.substring(text, 1, TIE_CHARS).alias("head"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("hash"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")).cast("long").alias("words"),
    )


def paths(turns: DataFrame, share: int | None = None) -> DataFrame:
    """(conv_id, depth, k1, k2, p1, p2, words, cum, ends): a row for each prefix of each conversation, the empty one at depth 0 included.

    (k1, k2) names the prefix, (p1, p2) its parent; words are those of its last text, cum those of all its texts; ends says that it is the whole
    conversation. Turns are ordered by turn (null first), then role, the first TIE_CHARS characters of the text, and a hash; null roles and
    texts are empty, repeated rows are turns of their own, a null conv_id is a conversation, less than all others.
    With share, conversation c is rebuilt: the first h turns of conversation c - c % share (modulo of a sign with share), then its own after its first h, h = crc32(c) % 4.
    One shuffle without texts; a task streams through its conversations and holds three turns.
    """
    dealt = _turns(turns, share).repartition("block").sortWithinPartitions("block", F.col("conv_id") != F.col("block"), "conv_id", "turn", "role", "head", "hash")
    return dealt.select("block", "conv_id", "hash", "words").mapInArrow(_chained_of(share), PATHS)


def _chained_of(share: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _chained(batches, share)

    return run


def _chained(batches: Iterator[pa.RecordBatch], share: int | None) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: hash chains of the conversations in a sorted partition."""
    root = bytes(16)
    block, conv, head, own, borrowed = None, None, [], 0, 0
    key, depth, cum = root, 0, 0
    out: list[tuple] = []  # the last row of a conversation waits here for the next

    def step(digest: bytes, words: int) -> None:
        nonlocal key, depth, cum
        parent, key = key, hashlib.blake2b(key + digest, digest_size=16).digest()
        depth, cum = depth + 1, cum + words
        out.append([conv, depth, key, parent, words, cum, False])

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        keys = np.frombuffer(b"".join(r[2] for r in rows), "<i8").reshape(-1, 2)
        parents = np.frombuffer(b"".join(r[3] for r in rows), "<i8").reshape(-1, 2)
        column = lambda k, t: pa.array([r[k] for r in rows], t)
        arrays = [column(0, pa.int64()), column(1, pa.int32()), *(pa.array(a[:, j].copy()) for a in (keys, parents) for j in (0, 1)), column(4, pa.int64()), column(5, pa.int64()), column(6, pa.bool_())]
        return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in PATHS.split(", ")])

    for batch in batches:
        for of, c, digest, words in zip(*(batch.column(k).to_pylist() for k in ("block", "conv_id", "hash", "words")), strict=True):
            if of != block:
                block, head = of, []
            if c != conv:
                if out:
                    out[-1][6] = True
                conv, own, key, depth, cum = c, 0, root, 0, 0
                borrowed = zlib.crc32(str(c).encode()) % 4 if share and c != block else 0
                out.append([conv, 0, root, root, 0, 0, False])
                for turn in head[:borrowed]:
                    step(*turn)
            own += 1
            if share and c == block and own <= 3:
                head.append((digest, words))
            if own > borrowed:
                step(digest, words)
        if len(out) > 20_000:
            yield batch_of(out[:-1])
            out = out[-1:]
    if out:
        out[-1][6] = True
        yield batch_of(out)


@dataclass
class Louds:
    """A forest in level order: bits holds, for the tops and then for each node in level order, a 1 for each child and a 0."""

    bits: np.ndarray
    labels: np.ndarray
    order: np.ndarray
    levels: list[int]

    @staticmethod
    def build(parent: np.ndarray, labels: np.ndarray) -> Louds:
        """parent: each node's parent, -1 for tops. Children follow each other by label. order: the node at each place; levels: where levels begin."""
        n = len(parent)
        by_parent = np.lexsort((labels, parent))
        starts = np.searchsorted(parent[by_parent], np.arange(-1, n + 1))
        degree, first = np.diff(starts), starts[:-1]  # [0] belongs to the super-root
        order, levels, now = [], [0], by_parent[: degree[0]]
        while len(now):
            order.append(now)
            levels.append(levels[-1] + len(now))
            many = degree[now + 1]
            at = np.repeat(first[now + 1] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
            now = by_parent[at]
        placed = np.concatenate(order) if order else np.zeros(0, np.int64)
        ones = np.concatenate((degree[:1], degree[placed + 1]))
        bits = np.ones(ones.sum() + len(ones), np.uint8)
        bits[np.cumsum(ones + 1) - 1] = 0
        return Louds(bits, labels[placed], placed, levels)

    def degrees(self) -> np.ndarray:
        """Children of each place, by the distance of the zeros."""
        return np.diff(np.flatnonzero(self.bits == 0)) - 1

    def parents(self) -> np.ndarray:
        """The place of each place's parent, -1 for tops: the zeros before its 1, less the super-root's."""
        ones = np.flatnonzero(self.bits)
        return np.cumsum(self.bits == 0)[ones] - 1

    def rolled_up(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees of values (places x columns), level by level from the last."""
        total, up = values.copy(), self.parents()
        for a, b in zip(self.levels[-2:0:-1], self.levels[:1:-1], strict=True):
            np.add.at(total, up[a:b], total[a:b])
        return total


EDGE = "conv_id long, n long, label long, p_conv long, p_n long, top int, bottom int, cum long, own long"
ROLLED = f"{EDGE}, is_top boolean, n_children long, n_leaves long, below long"


def _rolled(key: tuple, table: pa.Table) -> pa.Table:
    """For applyInArrow: one shard's edges (EDGE and more_children, more_leaves, more_saved from the shards below) with their rollups."""
    got = {c: table.column(c).to_numpy() for c in table.column_names if c not in ("p_conv", "p_n")}
    got |= {c: table.column(c).fill_null(0).to_numpy() for c in ("p_conv", "p_n")}
    no_parent = table.column("p_n").is_null().to_numpy()
    names = np.empty(len(no_parent), [("c", np.int64), ("n", np.int64)])
    names["c"], names["n"] = got["conv_id"], got["n"]
    by_name = np.argsort(names)
    asked = np.empty_like(names)
    asked["c"], asked["n"] = got["p_conv"], got["p_n"]
    at = np.minimum(np.searchsorted(names[by_name], asked), len(names) - 1)
    parent = np.where(~no_parent & (names[by_name][at] == asked), by_name[at], -1)
    trie = Louds.build(parent, got["label"])
    more = {c: got[f"more_{c}"][trie.order] for c in ("children", "leaves", "saved")}
    children = trie.degrees() + more["children"]
    own = got["own"][trie.order]
    total = trie.rolled_up(np.stack((np.where(children == 0, 1, more["leaves"]), own + more["saved"]), axis=1))
    shown = table.select([c.split()[0] for c in EDGE.split(", ")]).take(pa.array(trie.order))
    for name, column in (("is_top", parent[trie.order] < 0), ("n_children", children), ("n_leaves", total[:, 0]), ("below", total[:, 1] - own)):
        shown = shown.append_column(name, pa.array(column))
    return shown


def nodes_of(path_rows: DataFrame) -> DataFrame:
    """(k1, k2, depth, p1, p2, words, cum, n, conv_id): one row a prefix, by partial counts; a prefix that all share is one row a task."""
    first = [F.min(c).alias(c) for c in ("depth", "p1", "p2", "words", "cum")]  # alike in all rows of a key
    return path_rows.groupBy("k1", "k2").agg(*first, F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"))


def edges_of(nodes: DataFrame) -> DataFrame:
    """The compressed trie: nodes of the same least member and as many members lie on one path and have the same members, so they make one edge."""
    runs = nodes.groupBy("conv_id", "n").agg(
        F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.max("cum").alias("cum"), F.min(F.col("cum") - F.col("words")).alias("before"),
        *(F.min_by(c, "depth").alias(name) for c, name in (("k1", "label"), ("p1", "p1"), ("p2", "p2"))),
    )
    up = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("p_conv"), F.col("n").alias("p_n"))
    below = runs.where("top > 0").join(up, ["p1", "p2"])  # the hot side of a parent of many has one row
    both = below.unionByName(runs.where("top = 0"), allowMissingColumns=True)
    return both.withColumn("own", (F.col("n") - 1) * (F.col("cum") - F.col("before"))).select(*(c.split()[0] for c in EDGE.split(", ")))


def rollups(path_rows: DataFrame, nodes: DataFrame, light: int = LIGHT) -> DataFrame:
    """The edges of edges_of with n_children and n_leaves of their last node, and below: what the subtrees under it save."""
    n_rows, n_convs = path_rows.agg(F.count(F.lit(1)), F.count_if(F.col("depth") == 0)).first()
    light = max(light, math.isqrt(n_rows))
    edges = materialize(edges_of(nodes), "trie-edges")
    heavy = (F.col("n") > light) | (F.col("top") == 0)
    tall = nodes.where((F.col("n") > light) | (F.col("depth") == 0)).select("k1", "k2")
    if tall.count() <= BROADCAST_NODES:
        tall = F.broadcast(tall)
    # the first prefix of each conversation that is not heavy: all edges below it have its shard
    tops = path_rows.join(tall, ["k1", "k2"], "left_anti").groupBy("conv_id").agg(F.min_by("k1", "depth").alias("at"))
    shard = F.pmod(F.xxhash64("at"), F.lit(max(1, math.ceil(n_convs / light))))
    nothing = {f"more_{c}": F.lit(0).cast("long") for c in ("children", "leaves", "saved")}
    sharded = edges.where(~heavy).join(tops, "conv_id").withColumn("shard", shard).withColumns(nothing)
    done = materialize(sharded.groupBy("shard").applyInArrow(_rolled, ROLLED), "trie-shards")
    given = done.where("is_top").groupBy(F.col("p_conv").alias("conv_id"), F.col("p_n").alias("n")).agg(
        F.count(F.lit(1)).alias("more_children"), F.sum("n_leaves").alias("more_leaves"), F.sum(F.col("below") + F.col("own")).alias("more_saved")
    )
    above = edges.where(heavy).join(given, ["conv_id", "n"], "left").fillna(0, list(nothing))
    return done.unionByName(above.groupBy(F.lit("above").alias("shard")).applyInArrow(_rolled, ROLLED))


def _ends(path_rows: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) of prefixes that are whole conversations: a task streams through its sorted rows and holds one hash."""
    dealt = path_rows.where("ends").select("k1", "k2", "conv_id").repartition("k1", "k2").sortWithinPartitions("k1", "k2", "conv_id")
    return dealt.mapInArrow(_hashed_ends, "k1 long, k2 long, ends_sha256 string")


def _hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, sha, some, out = None, None, False, []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["k1", "k2", "ends_sha256"])

    for batch in batches:
        for k1, k2, c in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if (k1, k2) != now:
                if now:
                    out.append((*now, sha.hexdigest()))
                now, sha, some = (k1, k2), hashlib.sha256(), False
            if c != NO_ID:
                sha.update(f",{c}".encode() if some else str(c).encode())
                some = True
        if len(out) > 20_000:
            yield batch_of(out)
            out = []
    if now:
        yield batch_of([*out, (*now, sha.hexdigest())])


def prefix_trie(turns: DataFrame, share: int | None = None, light: int = LIGHT) -> DataFrame:
    """One row for each node of the trie of turns (conv_id, turn, role, text): see paths for how turns are ordered and what share does.

    conv_id: the smallest member; depth; parent_conv_id: the parent's conv_id (null for the root); n_convs: members; n_children; n_leaves:
    childless nodes of the subtree; saved_tokens: over the subtree, (members - 1) times the words of a node's last text; ends_sha256: of the
    decimal ids, in order, comma-joined, of conversations that end at the node. The null conversation counts as a member, shows as a null
    conv_id and is left out of ends. An empty table gives no rows.
    """
    path_rows = materialize(paths(turns, share), "trie-paths")
    nodes = materialize(nodes_of(path_rows), "trie-nodes")
    rolled = rollups(path_rows, nodes, light).select("conv_id", "n", "top", "bottom", "p_conv", "n_children", "n_leaves", "below", F.col("cum").alias("all_words"))
    shown = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    joined = nodes.join(rolled, ["conv_id", "n"]).join(_ends(path_rows), ["k1", "k2"], "left")
    parent: Column = F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") == F.col("top"), shown("p_conv")).otherwise(shown("conv_id"))
    return joined.select(
        shown("conv_id").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        parent.cast("long").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(F.col("depth") == F.col("bottom"), F.col("n_children")).otherwise(1).cast("long").alias("n_children"),
        "n_leaves",
        (F.col("below") + (F.col("n") - 1) * (F.col("all_words") - F.col("cum") + F.col("words"))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
