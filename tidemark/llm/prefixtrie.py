"""Prefix trie of conversations in double arrays.

Every distinct sequence of first d turns (role and text) of a rebuilt conversation is a node of depth d; the root has no
turn. Equal conversations are counted together first, so the sequences that remain are distinct, and are sorted. A
prefix shard is a run of at most SHARD_ROWS consecutive sequences: whatever first turn, prefix or conversation is common,
shards stay equal in size. Each shard numbers its turns densely, packs its sequences into BASE and CHECK arrays, and walks
them for its nodes and their sums. Only nodes on a shard's first or last sequence can belong to other shards too; those
shared upper nodes are merged by their path's 128-bit hash. Consecutive shards share exactly the common prefix of the one's
last and the other's first sequence, so what both have counted there is taken off once for each such pair.

Turns are told apart by two 64-bit hashes of role and text; texts are never moved. One conversation's turns (24 bytes
each) are together in one row, as are the nodes of a shard; ids of conversations that end at one node are hashed as a
stream, in chunks, so no group of copies is held.

Defined results: rows without conv_id belong to no conversation and are left out; a null role or text is empty; turns of
equal number are ordered by role, size and hash; repeated rows are turns of their own; a conversation whose rebuilt form
has no turn ends at the root; an empty table gives no node, not even the root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidemark.llm import words
from tidemark.llm.sqltext import crc32
from tidemark.llm.store import keep

#: Conversations of one block share first turns; a conversation takes fewer than HEADS turns of its block's first one.
BLOCK, HEADS, SHARD_ROWS, TRIES = 5, 9, 10_000, 64
U = np.uint64
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
TURNS = "array<struct<k1:bigint,k2:bigint,size:bigint>>"
#: inner nodes are complete; shared ones, and what is to be taken off them, are summed by id.
NODE = "kind int, id1 bigint, id2 bigint, up1 bigint, up2 bigint, up_shared boolean, depth bigint, conv_id bigint, up_conv bigint, n_convs bigint, n_children bigint, n_leaves bigint, weighed bigint, plain bigint, ends string"
INNER, SHARED, EDGE = 0, 1, 2
PART = f"{NODE}, part int, first {TURNS}, last {TURNS}"
_NODE_SCHEMA = pa.schema([("kind", pa.int32()), *((n, pa.int64()) for n in ("id1", "id2", "up1", "up2")), ("up_shared", pa.bool_()), *((n, pa.int64()) for n in ("depth", "conv_id", "up_conv", "n_convs", "n_children", "n_leaves", "weighed", "plain")), ("ends", pa.string())])
_TURNS_TYPE = pa.list_(pa.struct([("k1", pa.int64()), ("k2", pa.int64()), ("size", pa.int64())]))
_PART_SCHEMA = pa.schema([*_NODE_SCHEMA, ("part", pa.int32()), ("first", _TURNS_TYPE), ("last", _TURNS_TYPE)])


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order, each as two hashes and the text's UTF-8 bytes."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), F.octet_length(text).cast("long").alias("size"), F.xxhash64(role, text).alias("k1"), F.xxhash64(text, role).alias("k2")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.transform("t", lambda t: F.struct(t["k1"].alias("k1"), t["k2"].alias("k2"), t["size"].alias("size"))).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id and turns of every rebuilt conversation: the first h turns of its block's first conversation, then its own
    after its first h; h is the CRC-32 of its decimal conv_id modulo HEADS."""
    own = keep(sequences(conversations), "sequences")
    heads = own.filter(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("block"), F.slice("turns", 1, HEADS - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    both = own.select("*", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("block")).join(heads, "block", "left")
    head, tail = F.expr("slice(head, 1, h)"), F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))")
    return both.select("conv_id", F.concat(F.coalesce(head, F.expr(f"cast(array() as {TURNS})")), tail).alias("turns"))


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks (s1, s2, ids as text, n, first id) in order to one row a sequence: first id, number and digest of the ids."""
    key, first, n, sha = None, 0, 0, hashlib.sha256()

    def out(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["conv_id", "n", "ends"])

    for b in batches:
        done = []
        for s1, s2, text, size, least in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if (s1, s2) != key:
                if key is not None:
                    done.append((first, n, sha.hexdigest()))
                key, first, n, sha = (s1, s2), least, 0, hashlib.sha256()
            sha.update(b"," * (n > 0) + text.encode())
            n += size
        yield out(done)
    if key is not None:
        yield out([(first, n, sha.hexdigest())])


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """The distinct sequences of convs(conv_id, turns) with their smallest conv_id, number and digest of ids (n, ends)."""
    ids = convs.select("conv_id", F.xxhash64("turns").alias("s1"), F.xxhash64(F.lit(1), "turns").alias("s2"), F.shiftright("conv_id", 8).alias("chunk"))
    chunks = ids.groupBy("s1", "s2", "chunk").agg(F.sort_array(F.collect_list("conv_id")).alias("ids")).select("s1", "s2", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("text"), F.size("ids").cast("long").alias("n"), F.element_at("ids", 1).alias("least"), "chunk")
    ends = chunks.repartition("s1", "s2").sortWithinPartitions("s1", "s2", "chunk").drop("chunk").mapInArrow(_ends, "conv_id bigint, n bigint, ends string")
    return convs.join(ends, "conv_id")


class DoubleArray:
    """A trie of sorted distinct sequences of turn keys: the child of slot s by dense turn id i is BASE[s] + i, and its
    CHECK is s. Ids are given in the order in which the levels meet turns, so a slot's children lie close together."""

    def __init__(self, key: np.ndarray, off: np.ndarray):
        self.dense = np.full(int(key.max()) + 1 if len(key) else 0, -1, np.int64)
        self.base, self.check = np.zeros(64, np.int64), np.full(64, -1, np.int64)
        self.top, self.holes, self.used = 1, [], 0
        self._pack(key, off)

    def _room(self, n: int) -> None:
        if n > len(self.base):
            more = max(n, 2 * len(self.base)) - len(self.base)
            self.base, self.check = np.concatenate([self.base, np.zeros(more, np.int64)]), np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _number(self, keys: np.ndarray) -> np.ndarray:
        new, at = np.unique(keys[self.dense[keys] < 0], return_index=True)
        self.dense[new[np.argsort(at)]] = np.arange(self.used, self.used + len(new))
        self.used += len(new)
        return self.dense[keys]

    def _place(self, slot: int, ids: np.ndarray) -> None:
        """Finds a base at which all children of one slot fall into free places."""
        step = ids - ids.min()
        span = int(step.max()) + 1
        for some in (slice(0, TRIES), slice(-TRIES, None)):
            self.holes[some] = [i for i in self.holes[some] if self.check[i] < 0]
        for at in [*self.holes[:TRIES], *self.holes[-TRIES:], self.top]:
            self._room(at + span)
            if (self.check[at + step] < 0).all():
                break
        self.base[slot] = at - ids.min()
        self.check[at + step] = slot
        gap = np.arange(self.top, at + span)
        self.holes += gap[self.check[gap] < 0].tolist()
        self.top = max(self.top, at + span)

    def _pack(self, key: np.ndarray, off: np.ndarray) -> None:
        size = np.diff(off)
        rows, slot, depth = np.flatnonzero(size > 0), None, 0
        slot = np.zeros(len(rows), np.int64)
        while len(rows):
            k = key[off[rows] + depth]
            head = np.ones(len(rows), bool)
            head[1:] = (slot[1:] != slot[:-1]) | (k[1:] != k[:-1])
            parent, ids = slot[head], self._number(k[head])
            first = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
            count = np.diff(np.append(first, len(parent)))
            for a, n in zip(first[count > 1], count[count > 1], strict=True):
                self._place(int(parent[a]), ids[a : a + n])
            one = first[count == 1]
            free = self._free(len(one))
            self.base[parent[one]] = free - ids[one]
            self.check[free] = parent[one]
            slot = (self.base[parent] + ids)[np.cumsum(head) - 1]
            depth += 1
            on = size[rows] > depth
            rows, slot = rows[on], slot[on]

    def _free(self, n: int) -> np.ndarray:
        """n free slots: holes first, then new ones."""
        old, self.holes = self.holes[:n], self.holes[n:]
        old = [i for i in old if self.check[i] < 0]
        new = np.arange(self.top, self.top + n - len(old))
        self.top += len(new)
        self._room(self.top)
        return np.concatenate([np.array(old, np.int64), new])

    def step(self, slot: np.ndarray, key: np.ndarray) -> np.ndarray:
        """The children of slots by turn keys."""
        to = self.base[slot] + self.dense[key]
        if (self.check[to] != slot).any():
            raise ValueError("the double array lacks a sequence that it was made of")
        return to


def _next_id(a: np.ndarray, b: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The id of a child from its parent's and the turn's hashes."""
    return words.mix(a * U(0x9E3779B97F4A7C15) + k1.astype(U)), words.mix(b * U(0xC2B2AE3D27D4EB4F) ^ k2.astype(U))


class Sequences:
    """Sorted distinct sequences of one shard as flat arrays."""

    def __init__(self, turns: pa.ListArray):
        off = turns.offsets.to_numpy().astype(np.int64)
        flat = turns.values.slice(off[0], off[-1] - off[0])
        self.off = off - off[0]
        self.k1, self.k2, self.size = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.off[i], self.off[i + 1]
        return self.k1[a:b], self.k2[a:b], self.size[a:b]

    def keys(self) -> np.ndarray:
        """A number for each distinct turn."""
        order = np.lexsort([self.k2, self.k1])
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(self.k1[order]) != 0) | (np.diff(self.k2[order]) != 0)
        out = np.zeros(len(order), np.int64)
        out[order] = np.cumsum(new) - 1
        return out


def nodes_of_shard(rows: Sequences, conv: np.ndarray, n: np.ndarray, ends: list[str]) -> pa.RecordBatch:
    """The nodes of one shard with their sums over it, found by walking its sequences through a double array."""
    key = rows.keys()
    trie = DoubleArray(key, rows.off)
    m = trie.top
    members, least, own, leaves, children = (np.zeros(m, np.int64) for _ in range(5))
    least[:] = np.iinfo(np.int64).max
    id1, id2, depth_of, end = np.zeros(m, U), np.zeros(m, U), np.zeros(m, np.int64), np.full(m, -1, np.int64)
    shared = np.zeros(m, bool)
    length = np.diff(rows.off)
    active, slot, levels, depth = np.arange(len(conv)), np.zeros(len(conv), np.int64), [], 0
    while len(active):
        head = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        here = slot[head]
        levels.append(here)
        members[here], least[here] = np.add.reduceat(n[active], head), np.minimum.reduceat(conv[active], head)
        depth_of[here] = depth
        for edge, of in ((0, 0), (-1, len(conv) - 1)):
            if active[edge] == of:
                shared[slot[edge]] = True
        last = length[active] == depth
        end[slot[last]] = active[last]
        active, slot = active[~last], slot[~last]
        if len(active):
            at = rows.off[active] + depth
            to = trie.step(slot, key[at])
            id1[to], id2[to] = _next_id(id1[slot], id2[slot], rows.k1[at], rows.k2[at])
            own[to] = rows.size[at]
            slot = to
        depth += 1
    weighed, plain = members * own, own.copy()
    for here in reversed(levels):
        leaves[here[children[here] == 0]] = 1
        up = trie.check[here]
        here, up = here[up >= 0], up[up >= 0]
        for sums, x in ((children, np.ones(len(here), np.int64)), (leaves, leaves[here]), (weighed, weighed[here]), (plain, plain[here])):
            np.add.at(sums, up, x)
    s = np.concatenate(levels)
    up = trie.check[s]
    no = up < 0
    signed = lambda x: x.view(np.int64)
    cols = [np.where(shared[s], SHARED, INNER).astype(np.int32), signed(id1[s]), signed(id2[s]), pa.array(signed(id1[up]), mask=no), pa.array(signed(id2[up]), mask=no), shared[up] & ~no, depth_of[s], least[s], pa.array(least[up], mask=no), members[s], children[s], leaves[s], weighed[s], plain[s]]
    return pa.RecordBatch.from_arrays([*(pa.array(c) for c in cols), pa.array([ends[e] if e >= 0 else None for e in end[s]], pa.string())], schema=_NODE_SCHEMA)


def counted_twice(a: tuple, b: tuple) -> pa.RecordBatch:
    """What shards that end with sequence a and begin with b have both counted, as negative sums of the nodes they share."""
    m = min(len(a[0]), len(b[0]))
    differ = np.flatnonzero((a[0][:m] != b[0][:m]) | (a[1][:m] != b[1][:m]))
    n = int(differ[0]) if len(differ) else m
    id1, id2 = np.zeros(n + 1, U), np.zeros(n + 1, U)
    for d in range(n):
        id1[d + 1 : d + 2], id2[d + 1 : d + 2] = _next_id(id1[d : d + 1], id2[d : d + 1], a[0][d : d + 1], a[1][d : d + 1])
    none, zero = pa.nulls(n + 1, pa.int64()), np.zeros(n + 1, np.int64)
    below = np.concatenate([[0], a[2][:n]])[::-1].cumsum()[::-1]
    cols = [np.full(n + 1, SHARED, np.int32), id1.view(np.int64), id2.view(np.int64), none, none, pa.nulls(n + 1, pa.bool_()), np.arange(n + 1), none, none, zero, np.where(np.arange(n + 1) < n, -1, 0), zero - int(n == len(a[0])), zero, -below, pa.nulls(n + 1, pa.string())]
    return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in cols], schema=_NODE_SCHEMA)


def _with_edges(nodes: pa.RecordBatch, part: int | None = None, first: tuple | None = None, last: tuple | None = None) -> pa.RecordBatch:
    """nodes, or one row of a partition's first and last sequence, in the layout of PART."""
    if first is None:
        n = nodes.num_rows
        return pa.RecordBatch.from_arrays([*nodes.columns, pa.nulls(n, pa.int32()), pa.nulls(n, _TURNS_TYPE), pa.nulls(n, _TURNS_TYPE)], schema=_PART_SCHEMA)
    turns = lambda t: pa.array([[{"k1": int(a), "k2": int(b), "size": int(c)} for a, b, c in zip(*t, strict=True)]], _TURNS_TYPE)
    return pa.RecordBatch.from_arrays([pa.array([EDGE], pa.int32()), *(pa.nulls(1, f.type) for f in list(_NODE_SCHEMA)[1:]), pa.array([part], pa.int32()), turns(first), turns(last)], schema=_PART_SCHEMA)


def _tries(shard_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, last = TaskContext.get().partitionId(), None, None
        for batch in batches:
            for i in range(0, batch.num_rows, shard_rows):
                b = batch.slice(i, shard_rows)
                rows = Sequences(b.column(0))
                begin = rows.row(0)
                if last is not None:
                    yield _with_edges(counted_twice(last, begin))
                first, last = begin if first is None else first, rows.row(b.num_rows - 1)
                yield _with_edges(nodes_of_shard(rows, *(b.column(c).to_numpy(zero_copy_only=False) for c in (1, 2)), b.column(3).to_pylist()))
        if first is not None:
            yield _with_edges(None, part, first, last)

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            yield counted_twice(*(Sequences(b.column(c).slice(i, 1)).row(0) for c in (0, 1)))


def trie(convs: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The nodes of the prefix trie of convs(conv_id, turns), see rebuilt: conv_id (the smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    spark = convs.sparkSession
    seqs = distinct_sequences(keep(convs, "conversations"))
    parts = keep(seqs.select("turns", "conv_id", "n", "ends").repartitionByRange("turns").sortWithinPartitions("turns").mapInArrow(_tries(shard_rows), PART), "tries")
    edges = parts.filter(F.col("kind") == EDGE).select("part", "first", "last")
    order = sorted(r["part"] for r in edges.select("part").collect())  # one number a partition
    after = spark.createDataFrame(list(zip(order[:-1], order[1:], strict=True)), "part int, next int")
    pairs = edges.join(after, "part").join(edges.select(F.col("part").alias("next"), F.col("first").alias("begin")), "next").select("last", "begin")
    node = [c.split()[0] for c in NODE.split(", ")]
    ids = ["id1", "id2", "depth"]
    sums = ["n_convs", "n_children", "n_leaves", "weighed", "plain"]
    merged = keep(parts.filter(F.col("kind") == SHARED).select(*node).unionByName(pairs.mapInArrow(_pairs, NODE)).groupBy(*ids).agg(*(F.max(c).alias(c) for c in ("up1", "up2", "ends")), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in sums)), "shared-nodes")
    every = parts.filter(F.col("kind") == INNER).select(*node).drop("kind").unionByName(merged.select("*", (F.col("depth") > 0).alias("up_shared"), F.lit(None).cast("long").alias("up_conv")))
    above = merged.select(F.col("id1").alias("a1"), F.col("id2").alias("a2"), F.col("depth").alias("ad"), F.col("conv_id").alias("above"))
    found = every.join(above, F.col("up_shared") & (F.col("up1") == F.col("a1")) & (F.col("up2") == F.col("a2")) & (F.col("depth") == F.col("ad") + 1), "left")
    return found.select("conv_id", "depth", F.coalesce("above", "up_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", (F.col("weighed") - F.col("plain")).alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def nodes(conversations: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The trie of all rebuilt conversations."""
    return trie(rebuilt(conversations), shard_rows)



ORACLE = f"""
WITH own AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), strlen(coalesce(text, ''))) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
cut AS (SELECT conv_id, turns, CAST({crc32("CAST(conv_id AS VARCHAR)")} % {HEADS} AS BIGINT) AS h FROM own),
rebuilt AS (SELECT a.conv_id, list_concat(CASE WHEN b.turns IS NULL THEN [] ELSE b.turns[1:a.h] END, a.turns[a.h + 1:]) AS turns FROM cut a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % {BLOCK}),
steps AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM rebuilt),
prefixes AS (SELECT conv_id, depth, CASE WHEN depth = 0 THEN '' ELSE md5(CAST(turns[1:depth] AS VARCHAR)) END AS node, CASE WHEN depth < 2 THEN '' ELSE md5(CAST(turns[1:depth - 1] AS VARCHAR)) END AS up, CASE WHEN depth = 0 THEN 0 ELSE strlen(turns[depth].t) END AS size, depth = len(turns) AS ends, turns FROM steps),
nodes AS (SELECT node, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256, any_value(turns) AS turns FROM prefixes GROUP BY node, depth),
kids AS (SELECT up AS node, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
full_nodes AS (SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN kids k USING (node, depth)),
above AS (SELECT n_convs, size, n_children, turns, unnest(range(0, depth + 1)) AS depth FROM full_nodes),
subtrees AS (SELECT CASE WHEN depth = 0 THEN '' ELSE md5(CAST(turns[1:depth] AS VARCHAR)) END AS node, depth, sum(CAST(n_children = 0 AS INT)) AS n_leaves, sum((n_convs - 1) * size) AS saved FROM above GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN subtrees s USING (node, depth) LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.up AND p.depth = n.depth - 1"""
