"""Prefix trie of conversations: balanced parentheses per shard, shared spines merged.

Distinct conversations are sorted by the keys of their turns and dealt out in ranges.  A shard writes the trie of
its range as balanced parentheses; blocks of their excess with its minimum find where each subtree closes, the rank
of "()" counts its leaves, and cumulative arrays give its members and savings.  Only nodes on the way to a
shard's first or last conversation can also be in another shard: these spines are joined into a trie of
their own, in which everything that hangs off them is a weight.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from credence.llm.common import written

#: Bytes of a turn's key: the first of the SHA-256 of its role and text.
KEY_BYTES = 16
#: Bits of the range of conversation ids whose members of one ending are listed together.
ID_BITS = 16
#: Bytes of paths of a shard, about.
SHARD_BYTES = 16_000_000
#: Parentheses of a block of excess values.
BLOCK = 64
#: SHA-256 of the empty string: the ends of a node at which no conversation ends.
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: A node on a shard's way to its first or last path: size of its last turn, and what the shard hangs off it besides further such nodes.
HANG = "array<struct<size:long,n:long,least:long,n_children:long,n_leaves:long,saved:long,ends:string>>"
_FAR = np.iinfo(np.int64).max


# --- conversations as paths ------------------------------------------------------------------------------------------------


def rebuilt(conversations: DataFrame, family: Column, head: Column, most: int) -> DataFrame:
    """(conv_id, path binary, sizes array<int>): every conversation as the keys and code points of its rebuilt turns.

    The first ``head`` turns (``most`` at most) are those of conversation ``family``: all it has if fewer, none if
    there is no such conversation; the conversation's own turns after its first ``head`` follow.  Both are
    columns over ``conv_id``.  Turns are in order of turn, null first, equal ones by their keys; a null role or
    text is empty; rows without conv_id are in no conversation.  A conversation's keys are brought together, not its
    texts.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.left(F.sha2(F.encode(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), "UTF-8"), 256), F.lit(2 * KEY_BYTES))
    number = F.col("turn").cast("long")
    turn = F.struct(number.isNotNull().alias("known"), F.coalesce(number, F.lit(0)).alias("turn"), F.unhex(key).alias("key"), F.length(text).alias("size"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).where("conv_id is not null")
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    whole = written(whole.select("conv_id", F.transform("t", lambda t: F.struct(t["key"].alias("key"), t["size"].alias("size"))).alias("t")), "conversations")
    wanted = whole.withColumns({"family": family.cast("long"), "head": F.least(head.cast("int"), F.lit(most))})
    families = wanted.select(F.col("family").alias("conv_id")).distinct()
    first = whole.select("conv_id", F.slice("t", 1, most).alias("f")).join(families, "conv_id", "left_semi").withColumnRenamed("conv_id", "family")
    none = "cast(array() as array<struct<key:binary,size:int>>)"
    turns = F.expr(f"concat(slice(coalesce(f, {none}), 1, head), slice(t, head + 1, greatest(size(t) - head, 0)))")
    joined = wanted.join(first, "family", "left").select("conv_id", turns.alias("t"))
    path = F.unhex(F.array_join(F.transform("t", lambda t: F.hex(t["key"])), ""))
    return joined.select("conv_id", path.alias("path"), F.transform("t", lambda t: t["size"]).alias("sizes"))


def endings(paths: DataFrame) -> DataFrame:
    """(path, id_range, sizes, n, least, ids): the conversations of each path, per range of 2**ID_BITS ids, as ascending decimal text.

    Copies meet only per range of ids, so no group grows with the number of copies.
    """
    grouped = paths.groupBy("path", F.expr(f"conv_id >> {ID_BITS}").alias("id_range")).agg(
        F.first("sizes").alias("sizes"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"), F.sort_array(F.collect_list("conv_id")).alias("ids"))
    return grouped.withColumn("ids", F.array_join("ids", ","))


# --- one trie --------------------------------------------------------------------------------------------------------------------


class Parentheses:
    """Balanced parentheses with a tree of the least excess of every block of BLOCK places."""

    def __init__(self, opens: np.ndarray) -> None:
        self.excess = np.cumsum(np.where(opens, 1, -1))
        blocks = -(-len(opens) // BLOCK)
        padded = np.full(blocks * BLOCK, _FAR)
        padded[: len(opens)] = self.excess
        self.least = [padded.reshape(blocks, BLOCK).min(1)]
        while len(self.least[-1]) > 1:
            row = self.least[-1]
            self.least.append(np.append(row, [_FAR] * (len(row) % 2)).reshape(-1, 2).min(1))

    def _in_block(self, start: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """The first place from each ``start`` to the end of its block whose excess is ``goal``; -1 where there is none."""
        out, at, live = np.full(len(start), -1, np.int64), start.copy(), np.arange(len(start))
        end = np.minimum((start // BLOCK + 1) * BLOCK, len(self.excess))
        while len(live):
            live = live[at[live] < end[live]]
            hit = self.excess[at[live]] == goal[live]
            out[live[hit]] = at[live[hit]]
            live = live[~hit]
            at[live] += 1
        return out

    def close(self, opening: np.ndarray) -> np.ndarray:
        """Place of the parenthesis that closes each opening one: the first after it with less excess.

        The rest of its block is read; else the tree of minima leads to the first later block that goes as low.
        """
        goal = self.excess[opening] - 1
        out = self._in_block(opening + 1, goal)
        far = np.flatnonzero(out < 0)
        node, level, low = (opening[far] + 1) // BLOCK, np.zeros(len(far), np.int64), goal[far]
        climbing = np.arange(len(far))
        for k, row in enumerate(self.least):  # up, until the block to the right goes low enough
            right = node[climbing] + 1
            found = (right % 2 == 1) & (right < len(row)) & (row[np.minimum(right, len(row) - 1)] <= low[climbing])
            node[climbing[found]], level[climbing[found]] = right[found], k
            climbing = climbing[~found]
            node[climbing] //= 2
        for k in range(len(self.least) - 1, 0, -1):  # and down to the first that does
            down = np.flatnonzero(level == k)
            left = 2 * node[down]
            node[down] = np.where(self.least[k - 1][left] <= low[down], left, left + 1)
            level[down] = k - 1
        out[far] = self._in_block(node * BLOCK, low)
        return out


def range_least(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The least of ``size`` values from each ``start``, by minima over windows that double."""
    out, log, window = np.empty(len(start), values.dtype), np.frexp(size.astype(np.float64))[1] - 1, values
    for k in range(int(log.max(initial=-1)) + 1):
        at = np.flatnonzero(log == k)
        out[at] = np.minimum(window[start[at]], window[start[at] + size[at] - (1 << k)])
        window = np.minimum(window[: -(1 << k)], window[1 << k :])
    return out


class Trie:
    """The trie of distinct sorted paths; nodes are numbered in preorder, 0 is the root.

    ``keys`` has the two halves of each turn's key, path after path; ``lengths`` the turns of each path.  A node
    belongs to the first path that has it (``row``).
    """

    def __init__(self, keys: np.ndarray, lengths: np.ndarray) -> None:
        n = len(lengths)
        first = np.cumsum(lengths) - lengths
        of = np.repeat(np.arange(n), lengths)
        at = np.arange(len(of)) - first[of]  # turns before
        prior = np.maximum(of - 1, 0)
        back = np.where((of > 0) & (at < lengths[prior]), first[prior] + at, -1)
        same = (back >= 0) & (keys[:, 0] == keys[back, 0]) & (keys[:, 1] == keys[back, 1])
        # turns shared with the path before: those up to the first that differs
        self.shared, some = lengths.copy(), np.flatnonzero(lengths)
        if len(some):
            self.shared[some] = np.minimum(lengths[some], np.minimum.reduceat(np.where(same, _FAR, at), first[some]))
        made = lengths - self.shared
        self.place = np.cumsum(made) - made + 1  # of each path's first own node
        row = np.repeat(np.arange(n), made)
        depth = np.arange(1, len(row) + 1) - self.place[row] + self.shared[row] + 1
        self.row, self.depth, self.lengths = np.append(0, row), np.append(0, depth), lengths
        self.turn = first[row] + depth - 1  # for all nodes but the root: its last turn
        self.ends = np.where(made > 0, self.place + made - 1, 0)  # only the empty path has no own node
        # ahead of its own nodes, a path closes those of the path before that it does not share
        closes = np.append(0, lengths[:-1] - self.shared[1:])
        opens = np.concatenate([[True], np.repeat(np.tile([False, True], n), np.stack([closes, made], 1).ravel()), np.zeros(lengths[-1] + 1, bool)])
        self.open = np.flatnonzero(opens)
        self.close = Parentheses(opens).close(self.open)
        self.size = (self.close - self.open + 1) // 2
        self.pair = np.append(opens[:-1] & ~opens[1:], False)
        self.parent = np.arange(-1, len(self.row) - 1)
        own = np.flatnonzero(made)
        self.parent[self.place[own]] = self.before(self.place[own], self.shared[own])

    def before(self, nodes: np.ndarray, depths: np.ndarray) -> np.ndarray:
        """The last node of the given depth before each node: its ancestor, where the depth is less than its own."""
        n = len(self.depth)
        order = np.argsort(self.depth, kind="stable")
        return order[np.searchsorted(self.depth[order] * n + order, depths * n + nodes) - 1]

    def below(self, weights: np.ndarray) -> np.ndarray:
        """Sum of ``weights`` over each node's subtree, from its cumulative array."""
        total, start = np.append(0, np.cumsum(weights)), np.arange(len(weights))
        return total[start + self.size] - total[start]

    def least(self, values: np.ndarray) -> np.ndarray:
        return range_least(values, np.arange(len(values)), self.size)

    def leaves(self, out: np.ndarray) -> np.ndarray:
        """Childless nodes of each subtree but those of ``out``: the rank of "()" pairs at its close, less that at its opening."""
        pair = self.pair.copy()
        pair[self.open[out]] = False
        rank = np.cumsum(pair)
        return rank[self.close] - rank[self.open] + pair[self.open]

    def children(self) -> np.ndarray:
        return np.bincount(self.parent[1:], minlength=len(self.row))


# --- shards and their spines ----------------------------------------------------------------------------------------------------


def _halves(paths: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(b"".join(paths), "<u8").reshape(-1, 2)
    return keys, np.array([len(p) // KEY_BYTES for p in paths], np.int64)


def _table(schema: StructType, columns: dict[str, list | np.ndarray | pa.Array], n: int) -> pa.RecordBatch:
    """A batch with the given columns; the others are null."""
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = {f.name: to_arrow_type(f.dataType) for f in schema}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in kinds.items()], names=list(kinds))


def _shard(schema: StructType):
    """Nodes of one range of paths, and its two spines."""

    def run(batches):
        paths, sizes, members, least, digests, running = [], [], [], [], [], None
        for batch in batches:  # rows of one path follow each other, their ids in ascending order
            for path, size, n, low, ids in zip(*(batch.column(c).to_pylist() for c in ("path", "sizes", "n", "least", "ids"))):
                if paths and paths[-1] == path:
                    members[-1] += n
                    running.update(b"," + ids.encode())
                    continue
                if paths:
                    digests.append(running.hexdigest())
                paths.append(path)
                sizes.append(size)
                members.append(n)
                least.append(low)
                running = hashlib.sha256(ids.encode())
        if not paths:
            return
        digests.append(running.hexdigest())
        trie = Trie(*_halves(paths))
        nodes = len(trie.row)
        turn_sizes = np.array([s for row in sizes for s in row], np.int64)
        size = np.append(0, turn_sizes[trie.turn])
        own, low, ends = np.zeros(nodes, np.int64), np.full(nodes, _FAR), np.full(nodes, NO_ENDS, object)
        own[trie.ends], low[trie.ends], ends[trie.ends] = members, least, digests
        low, convs = trie.least(low), trie.below(own)
        left = np.arange(trie.lengths[0] + 1)
        right = trie.before(np.full(trie.lengths[-1] + 1, trie.ends[-1] + 1), np.arange(trie.lengths[-1] + 1))
        spine = np.zeros(nodes, bool)
        spine[left] = spine[right] = True
        children = trie.children()
        leaves, saved = trie.leaves(spine), trie.below(np.where(spine, 0, (convs - 1) * size))
        shard = TaskContext.get().partitionId()
        # what hangs off a spine node: its subtree without those of the spine nodes below it
        inner = np.flatnonzero(spine)[1:]
        hang = {"n": convs.copy(), "n_leaves": leaves.copy(), "saved": saved.copy(), "n_children": children.copy()}
        for values, part in ((hang["n"], convs), (hang["n_leaves"], leaves), (hang["saved"], saved), (hang["n_children"], np.ones(nodes, np.int64))):
            np.subtract.at(values, trie.parent[inner], part[inner])
        seen: set[int] = set()
        for side, way, path in [(0, left, paths[0]), (1, right, paths[-1])][: 1 if len(paths) == 1 else 2]:
            new = [v not in seen for v in way.tolist()]  # nodes of both sides count once
            seen.update(way.tolist())
            entries = [{
                "size": int(size[v]), "n": int(hang["n"][v]), "least": int(low[v]), "n_children": int(hang["n_children"][v]), "n_leaves": int(hang["n_leaves"][v]),
                "saved": int(hang["saved"][v]), "ends": ends[v] if own[v] else None,
            } if fresh else {"size": int(size[v]), "n": 0, "least": int(low[v]), "n_children": 0, "n_leaves": 0, "saved": 0, "ends": None} for v, fresh in zip(way.tolist(), new)]
            yield _table(schema, {"shard": [shard], "side": [side], "path": [path], "hang": [entries]}, 1)
        on_left = np.zeros(nodes, bool)
        on_left[left] = True
        plain = np.flatnonzero(~spine)
        for at in range(0, len(plain), 50_000):
            v = plain[at : at + 50_000]
            up = trie.parent[v]
            tied = spine[up]  # its parent is settled when the spines are merged
            yield _table(schema, {
                "conv_id": low[v], "depth": trie.depth[v], "parent_conv_id": pa.array(low[up], pa.int64(), mask=tied), "n_convs": convs[v], "n_children": children[v],
                "n_leaves": leaves[v], "saved_tokens": saved[v], "ends_sha256": ends[v].tolist(), "shard": np.full(len(v), shard),
                "side": pa.array(np.where(on_left[up], 0, 1), pa.int32(), mask=~tied)}, len(v))

    return run


def _merge(schema: StructType):
    """Nodes of the trie of all spines, and the smallest member of every node on a shard's spine."""

    def run(batches):
        rows = [r for batch in batches for r in batch.to_pylist()]
        if not rows:
            return
        trie = Trie(*_halves([r["path"] for r in rows]))
        nodes = len(trie.row)
        total = {c: np.zeros(nodes, np.int64) for c in ("n", "n_children", "n_leaves", "saved", "size")}
        low, ends, ways = np.full(nodes, _FAR), np.full(nodes, NO_ENDS, object), []
        way = np.zeros(1, np.int64)
        for i, r in enumerate(rows):
            way = np.concatenate([way[: trie.shared[i] + 1], np.arange(trie.place[i], trie.place[i] + trie.lengths[i] - trie.shared[i])])
            ways.append(way)
            for c in ("n", "n_children", "n_leaves", "saved"):
                total[c][way] += [h[c] for h in r["hang"]]
            total["size"][way] = [h["size"] for h in r["hang"]]
            low[way] = np.minimum(low[way], [h["least"] for h in r["hang"]])
            for v, h in zip(way.tolist(), r["hang"]):
                if h["ends"] is not None:
                    ends[v] = h["ends"]
        convs, low = trie.below(total["n"]), trie.least(low)
        yield _table(schema, {
            "conv_id": low, "depth": trie.depth, "parent_conv_id": pa.array(low[np.maximum(trie.parent, 0)], pa.int64(), mask=trie.parent < 0), "n_convs": convs,
            "n_children": trie.children() + total["n_children"], "n_leaves": trie.leaves(total["n_children"] > 0) + trie.below(total["n_leaves"]),
            "saved_tokens": trie.below((convs - 1) * total["size"] + total["saved"]), "ends_sha256": ends.tolist()}, nodes)
        for r, way in zip(rows, ways):
            n = len(way)
            yield _table(schema, {"conv_id": low[way], "depth": np.arange(n), "shard": np.full(n, r["shard"]), "side": np.full(n, r["side"])}, n)

    return run


def trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """Nodes of the trie of all (conv_id, path, sizes): conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Equal paths are counted before they meet, so copies make no large group; the ids of the conversations that
    end at a node pass through one running hash in order, range by range, and are never held together.  Paths are dealt
    to ``shards`` ranges (by their bytes, at least the session's shuffle partitions), each written once; the merge
    of the spines reads two rows per shard.
    """
    spark = paths.sparkSession
    ends = written(endings(paths), "endings")
    if shards is None:
        held = ends.agg(F.coalesce(F.sum(F.octet_length("path")), F.lit(0))).first()[0]
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // SHARD_BYTES))
    ranged = ends.repartitionByRange(shards, "path").sortWithinPartitions("path", "id_range")
    ddl = f"{NODE}, shard int, side int, path binary, hang {HANG}"
    columns = [c.split()[0] for c in NODE.split(", ")]
    parts = written(ranged.mapInArrow(_shard(StructType.fromDDL(ddl)), ddl), "trie-shards")
    spines = parts.where("path is not null").select("shard", "side", "path", "hang")
    ddl = f"{NODE}, shard int, side int"
    merged = written(spines.repartition(1).sortWithinPartitions("path").mapInArrow(_merge(StructType.fromDDL(ddl)), ddl), "trie-spines")
    nodes = parts.where("path is null")
    tied = nodes.where("side is not null").drop("parent_conv_id", "path", "hang").withColumn("up", F.col("depth") - 1)
    known = merged.where("shard is not null").select("shard", "side", F.col("depth").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    return (nodes.where("side is null").select(columns).unionByName(merged.where("shard is null").select(columns))
            .unionByName(tied.join(known, ["shard", "side", "up"]).select(columns)))


def shared_prefixes(conversations: DataFrame) -> DataFrame:
    """The trie of all conversations, rebuilt: conversation c starts with the first crc32(c) % 6 turns of conversation c - c % 100.

    Null role or text is empty, null turns come first, turns of equal number are in order of their keys, repeated rows
    are turns of their own; rows without conv_id are in no conversation; a conversation without a rebuilt turn is
    a member of the root; other columns are not read; an empty table gives no rows.  A conversation is one row of
    its turns' keys (20 bytes a turn), however long.
    """
    number = F.col("conv_id")
    return trie(rebuilt(conversations, number - number % 100, F.crc32(F.encode(number.cast("string"), "UTF-8")) % 6, 5))
