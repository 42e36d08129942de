"""Conversation prefix trie by family-first merging.

Conversations whose ids share a base (conv_id - conv_id % `family`) are a family; each begins with some turns of the base conversation.
The steps:

1. A turn becomes 16 bytes of a SHA-256 over its role and text, and its number of words: texts aren't shuffled.
2. Families and their base conversations are cogrouped by base id. A task rebuilds a family's conversations and builds their small trie.
   A node's key is (depth, sum of the hashes of its (place, turn) pairs, in two 64-bit lanes).
3. Only the combined nodes of families are shuffled and merged by key, with map-side combine, so a prefix that a third of all conversations
   share is one row a family, and then one a task.
4. The nodes that have the same smallest member are a chain: consecutive depths of that member's path. A node's subtree is the rest of its
   chain and the chains that hang on it. Totals of chains come by pointer doubling (rounds grow with the logarithm of how deep chains hang
   on one another), those of nodes by sums along a chain.

Hot groups: a conversation of more than `whole` turns goes to its family with its first `whole` turns only; the others are placed by
range partitions, hashed in parts of `whole`, and continue the sums of the first (any number of tasks a conversation). Members that end
at a node are joined to text in blocks of 4,096 consecutive ids, and the blocks of a node hashed one after another as a stream.
Chains are summed in blocks of depths.

Defined cases: turns are ordered by turn (null first), equal ones by the SHA-256 of their role and text, so repeated rows stay and have
an order; null role or text is empty; rows with null conv_id belong to no conversation; an empty table gives an empty result; other
columns are ignored. Texts are told apart by 128 bits of SHA-256.
"""

from __future__ import annotations

from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, release, small_batches, spread_join, word_count
from .textkernel import mix

KEY = ["depth", "k1", "k2"]
_NODES = "depth long, k1 long, k2 long, p1 long, p2 long, conv_id long, n_convs long, words long, ends array<long>, tail long"
_LANES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def heads(conv_id: int) -> int:
    """How many turns of the base conversation a conversation begins with."""
    return crc32(str(conv_id).encode()) % 4


def _lanes(d: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    """16-byte digests as two columns of unsigned numbers, in the order of their bytes."""
    whole = np.frombuffer(b"".join(d.to_pylist()), ">u8").reshape(-1, 2)
    return [whole[:, i].astype(np.uint64) for i in range(2)]


def _placed(lane: np.ndarray, depth: np.ndarray, i: int) -> np.ndarray:
    """The hash of a turn at its place; prefixes are told apart by the sums of them."""
    return mix(lane ^ mix(depth.astype(np.uint64) + _LANES[i]))


def _table(rows: dict) -> pa.Table:
    kinds = {"ends": pa.list_(pa.int64())}
    return pa.table({k: pa.array(v, kinds.get(k, pa.int64()), from_pandas=False) for k, v in rows.items()})


def family_trie(members: pa.Table, base: pa.Table) -> pa.Table:
    """The combined nodes of a family: its conversations, rebuilt with the first turns of the base conversation, which is a member too.

    Columns conv_id, turn, d, words, more (whether the conversation goes on beyond these rows). A conversation that goes on has no end
    here, but a row with its id as `tail`, and its depth and sums so far.
    """
    rows = pa.concat_tables([base, members])
    conv = rows.column("conv_id").to_numpy()
    turn = rows.column("turn")
    known = np.asarray(turn.is_valid())
    lanes = _lanes(rows.column("d"))
    order = np.lexsort((lanes[1], lanes[0], turn.fill_null(0).to_numpy(), known, conv))
    words, more = rows.column("words").to_numpy(), np.asarray(rows.column("more").to_numpy(zero_copy_only=False), bool)
    ids, first = np.unique(conv[order], return_index=True)
    stop = np.append(first[1:], len(order))
    top = base.column("conv_id")[0].as_py() if len(base) else None
    start = order[slice(*next(((a, b) for c, a, b in zip(ids, first, stop, strict=True) if c == top), (0, 0)))]
    paths = []
    for c, a, b in zip(ids.tolist(), first.tolist(), stop.tolist(), strict=True):
        h = heads(c)
        paths.append(np.concatenate([start[:h], order[a + h : b]]))
    lens = np.array([len(p) for p in paths])
    flat = np.concatenate(paths)
    owner = np.repeat(np.arange(len(ids)), lens)
    begin = np.cumsum(lens) - lens
    depth = np.arange(len(flat)) - np.repeat(begin, lens) + 1
    keys = []
    for i in range(2):
        total = np.cumsum(_placed(lanes[i][flat], depth, i), dtype=np.uint64)
        before = np.concatenate([np.zeros(1, np.uint64), total])[begin]
        keys.append((total - np.repeat(before, lens)).view(np.int64) if len(flat) else np.zeros(0, np.int64))
    parents = [np.where(depth > 1, np.concatenate([[0], k[:-1]]), 0) if len(k) else k for k in keys]
    by = np.lexsort((owner, keys[1], keys[0], depth))
    new = np.ones(len(by), bool)
    if len(by):
        a, b = by[1:], by[:-1]
        new[1:] = (depth[a] != depth[b]) | (keys[0][a] != keys[0][b]) | (keys[1][a] != keys[1][b])
    node = np.empty(len(by), np.int64)
    node[by] = np.cumsum(new)  # the root is 0
    lead = by[new]
    ends: list[list[int]] = [[] for _ in range(len(lead) + 1)]
    tails = []
    for j, c in enumerate(ids.tolist()):
        last = begin[j] + lens[j] - 1
        if more[order[first[j]]]:
            tails.append((int(lens[j]), *(int(k[last]) if lens[j] else 0 for k in keys), c))
        else:
            ends[node[last] if lens[j] else 0].append(c)
    n = len(tails)
    many = np.bincount(node, minlength=len(lead) + 1)
    return _table(
        {
            "depth": [0, *depth[lead].tolist(), *(x[0] for x in tails)],
            "k1": [0, *keys[0][lead].tolist(), *(x[1] for x in tails)],
            "k2": [0, *keys[1][lead].tolist(), *(x[2] for x in tails)],
            "p1": [None, *parents[0][lead].tolist(), *[None] * n],
            "p2": [None, *parents[1][lead].tolist(), *[None] * n],
            "conv_id": [int(ids[0]), *ids[owner[lead]].tolist(), *[None] * n],
            "n_convs": [len(ids), *many[1:].tolist(), *[None] * n],
            "words": [0, *words[flat[lead]].tolist(), *[None] * n],
            "ends": ends + [[]] * n,
            "tail": [None] * (len(lead) + 1) + [x[3] for x in tails],
        }
    )


def _part_sum(rows: pa.Table) -> pa.Table:
    """One part of a long conversation: the sums of its turns' hashes at their places (d0: the depth of the conversation's first `whole` turns)."""
    depth = rows.column("depth").to_numpy()
    s = [int(np.sum(_placed(x, depth, i), dtype=np.uint64).view(np.int64)) for i, x in enumerate(_lanes(rows.column("d")))]
    return pa.table({"conv_id": rows.column("conv_id")[:1], "part": rows.column("part")[:1], "s1": pa.array([s[0]], pa.int64()), "s2": pa.array([s[1]], pa.int64())})


def _running(batches):
    """(conv_id, part, o1, o2): the sums before each part; rows come by conversation and part, with the sums of the first turns as part 0."""
    conv, sums = None, (0, 0)
    wrap = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)
    for batch in batches:
        out = []
        for x in batch.to_pylist():
            if x["conv_id"] != conv:
                conv, sums = x["conv_id"], (0, 0)
            out.append((conv, x["part"], *sums))
            sums = wrap(sums[0] + x["s1"]), wrap(sums[1] + x["s2"])
        yield pa.RecordBatch.from_pylist([dict(zip(("conv_id", "part", "o1", "o2"), x, strict=True)) for x in out], pa.schema([(c, pa.int64()) for c in ("conv_id", "part", "o1", "o2")]))


def _part_nodes(rows: pa.Table) -> pa.Table:
    """The nodes along one part of a long conversation."""
    rows = rows.sort_by("depth")
    depth, conv = rows.column("depth").to_numpy(), rows.column("conv_id")[0].as_py()
    out = {"depth": depth}
    for i, lane in enumerate(_lanes(rows.column("d"))):
        before = np.array(rows.column(f"o{i + 1}")[0].as_py(), np.int64).view(np.uint64)
        total = before + np.cumsum(_placed(lane, depth, i), dtype=np.uint64)
        out[f"k{i + 1}"] = total.view(np.int64)
        out[f"p{i + 1}"] = np.concatenate([before[None], total[:-1]]).view(np.int64)
    n = len(depth)
    last = rows.column("last").to_pylist()
    out = {k: out[k].tolist() for k in ("depth", "k1", "k2", "p1", "p2")}
    return _table(out | {"conv_id": [conv] * n, "n_convs": [1] * n, "words": rows.column("words").to_pylist(), "ends": [[conv] if x else [] for x in last], "tail": [None] * n})


def _hash_ends(batches):
    """(depth, k1, k2, ends_sha256) of rows (depth, k1, k2, ids), which come by node and block; ids are hashed as they come."""
    key, state = None, None
    schema = pa.schema([*((c, pa.int64()) for c in KEY), ("ends_sha256", pa.string())])
    for batch in batches:
        out = []
        for x in batch.to_pylist():
            at = (x["depth"], x["k1"], x["k2"])
            if at != key:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = at, sha256(x["ids"].encode())
            else:
                state.update(b"," + x["ids"].encode())
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema)
    if key is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, state.hexdigest()), strict=True))], schema)


class PrefixTrie:
    """family: ids of a family; whole: turns of the longest conversation that a family takes in one piece; block: ids, or depths, that are taken together."""

    def __init__(self, family: int = 20, whole: int = 1 << 14, block: int = 1 << 12):
        self.family, self.whole, self.block = family, max(4, whole), block

    def _turns(self, conversations: DataFrame) -> DataFrame:
        role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
        told = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256))
        rows = conversations.where("conv_id is not null")
        return rows.select("conv_id", "turn", F.substring(told, 1, 16).alias("d"), word_count("text").alias("words"))

    def _family_nodes(self, rows: DataFrame) -> DataFrame:
        """Cogroup of families and their base conversations."""
        base = F.col("conv_id") - F.col("conv_id") % self.family
        rows = rows.withColumn("base", base)
        top = rows.where("conv_id = base").select(*[F.col(c).alias(c) for c in rows.columns])  # columns of their own, as both sides are of one table
        return rows.where("conv_id <> base").groupBy("base").cogroup(top.groupBy("base")).applyInArrow(family_trie, _NODES)

    def _tails(self, long_: DataFrame, family: DataFrame) -> DataFrame:
        """The nodes beyond the first `whole` turns of long conversations."""
        carry = family.where("tail is not null").select(F.col("tail").alias("conv_id"), F.col("depth").alias("d0"), F.col("k1").alias("s1"), F.col("k2").alias("s2"))
        rows = long_.where("part > 0").join(carry.select("conv_id", "d0"), "conv_id")
        rows = rows.withColumn("depth", F.col("place") - self.whole + F.col("d0") + 1).withColumn("last", F.col("place") + 1 == F.col("turns"))
        rows = durable(rows.select("conv_id", "part", "depth", "d", "words", "last"), "trie-tails")
        sums = rows.select("conv_id", "part", "depth", "d").groupBy("conv_id", "part").applyInArrow(_part_sum, "conv_id long, part long, s1 long, s2 long")
        sums = sums.unionByName(carry.select("conv_id", F.lit(0).cast("long").alias("part"), "s1", "s2"))
        before = sums.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_running, "conv_id long, part long, o1 long, o2 long")
        nodes = durable(rows.join(before, ["conv_id", "part"]).groupBy("conv_id", "part").applyInArrow(_part_nodes, _NODES), "trie-tail-nodes")
        release(rows)
        return nodes

    def _long(self, rows: DataFrame, ids: DataFrame) -> DataFrame:
        """Turns of long conversations with their place: that in their range partition, and the sizes of the ranges before."""
        order = [F.col("turn").asc_nulls_first(), F.col("d")]
        ranged = rows.join(ids, "conv_id").repartitionByRange("conv_id", *order, F.monotonically_increasing_id())
        ranged = durable(ranged.withColumn("span", F.spark_partition_id()), "trie-ranged")
        before = F.sum("n").over(W.partitionBy("conv_id").orderBy("span").rowsBetween(W.unboundedPreceding, -1))
        per = ranged.groupBy("conv_id", "span").agg(F.count("*").alias("n")).select("conv_id", "span", F.coalesce(before, F.lit(0)).alias("offset"))
        place = F.row_number().over(W.partitionBy("conv_id", "span").orderBy(*order)) - 1 + F.col("offset")
        placed = ranged.join(per, ["conv_id", "span"]).withColumn("place", place).withColumn("part", F.floor(F.col("place") / self.whole))
        out = durable(placed.select("conv_id", "turn", "d", "words", "turns", "place", "part"), "trie-placed")
        release(ranged)
        return out

    def _ends(self, family: DataFrame) -> DataFrame:
        each = family.where("size(ends) > 0").select(*KEY, F.explode("ends").alias("c"))
        ids = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",")
        blocks = each.groupBy(*KEY, F.floor(F.col("c") / self.block).alias("b")).agg(ids.alias("ids"))
        rows = blocks.repartition(*KEY).sortWithinPartitions(*KEY, "b").select(*KEY, "ids")
        return rows.mapInArrow(_hash_ends, "depth long, k1 long, k2 long, ends_sha256 string")

    @staticmethod
    def _chain_totals(chains: DataFrame) -> DataFrame:
        """c, saved, leaves of each chain with all that hang on it, at any remove. chains(c, anc, saved, leaves), anc: the chain it hangs on."""
        cur = chains
        while cur.where("anc is not null").take(1):
            add = cur.where("anc is not null").groupBy(F.col("anc").alias("c")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"), F.count("*").alias("n"))
            both = cur.join(add, "c", "left")
            both = both.select("c", "anc", (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), "n")
            both = durable(both, "trie-chain-sums")
            up = both.where("n is not null").select(F.col("c").alias("anc"), F.col("anc").alias("next"), "n")
            new = durable(spread_join(both.drop("n"), up, ["anc"], "n").select("c", F.col("next").alias("anc"), "saved", "leaves"), "trie-chain-totals")
            release(both)
            if cur is not chains:
                release(cur)
            cur = new
        return cur.select("c", "saved", "leaves")

    def nodes(self, conversations: DataFrame) -> DataFrame:
        """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
        small_batches(conversations.sparkSession, 4096)
        rows = durable(self._turns(conversations), "trie-turns")  # light rows: the texts are read once
        many = durable(rows.groupBy("conv_id").agg(F.count("*").alias("turns")).where(F.col("turns") > self.whole), "trie-long")
        parts = []
        short = rows.withColumn("more", F.lit(False))
        if many.take(1):
            long_ = self._long(rows, many)
            first = long_.where("part = 0").select("conv_id", "turn", "d", "words", F.lit(True).alias("more"))
            short = short.join(many.select("conv_id"), "conv_id", "left_anti").unionByName(first)
        family = durable(self._family_nodes(short), "trie-families")
        parts.append(family.where("tail is null"))
        if many.take(1):
            tail = self._tails(long_, family)
            parts.append(tail)
            release(long_)
        all_ = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        merged = all_.groupBy(*KEY).agg(
            F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.first("words").alias("words"), F.first("p1").alias("p1"), F.first("p2").alias("p2")
        )
        merged = durable(merged, "trie-merged")
        ends = durable(self._ends(all_), "trie-ends")
        release(rows, family, many, *([tail] if len(parts) > 1 else []))

        kids = merged.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
        known = merged.join(kids, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
        known = durable(known.withColumn("above", F.col("depth") - 1), "trie-known")
        release(merged)
        over = known.where("n_children > 0").select(F.col("depth").alias("above"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
        over = over.withColumnRenamed("n_children", "n")
        linked = spread_join(known, over, ["above", "p1", "p2"], "n")
        own = ((F.col("n_convs") - 1) * F.col("words")).alias("saved")
        linked = linked.select(*KEY, "conv_id", "n_convs", "n_children", "parent_conv_id", own, F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaves"))
        linked = durable(linked, "trie-linked")
        release(known)

        chains = linked.groupBy(F.col("conv_id").alias("c")).agg(
            F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"), F.min("depth").alias("top"), F.min_by("parent_conv_id", "depth").alias("anc")
        )
        chains = durable(chains, "trie-chains")
        totals = self._chain_totals(chains.select("c", "anc", "saved", "leaves"))
        hung = totals.join(chains.where("anc is not null").select("c", F.col("anc").alias("conv_id"), (F.col("top") - 1).alias("depth")), "c")
        hung = hung.groupBy("conv_id", "depth").agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
        rows = linked.join(hung, ["conv_id", "depth"], "left").withColumn("blk", F.floor(F.col("depth") / self.block))
        rows = rows.withColumn("saved", F.col("saved") + F.coalesce("more_saved", F.lit(0))).withColumn("leaves", F.col("leaves") + F.coalesce("more_leaves", F.lit(0)))
        rows = durable(rows.drop("more_saved", "more_leaves"), "trie-rows")
        release(linked, chains)
        # Sums along a chain from a depth on: those of its own block, and of the blocks below in chains of several.
        block = rows.groupBy("conv_id", "blk").agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
        below = W.partitionBy("conv_id").orderBy(F.desc("blk")).rowsBetween(W.unboundedPreceding, -1)
        block = block.select("conv_id", "blk", F.sum("s").over(below).alias("s"), F.sum("l").over(below).alias("l")).where("s is not null")
        along = W.partitionBy("conv_id", "blk").orderBy(F.desc("depth"))
        rows = rows.withColumn("saved", F.sum("saved").over(along)).withColumn("leaves", F.sum("leaves").over(along))
        rows = rows.join(block, ["conv_id", "blk"], "left").join(ends, KEY, "left")
        return rows.select(
            "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
            (F.col("leaves") + F.coalesce("l", F.lit(0))).cast("long").alias("n_leaves"),
            (F.col("saved") + F.coalesce("s", F.lit(0))).cast("long").alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"),
        )
