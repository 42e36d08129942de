"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in alternation, user first, ending with
an allowed last role. Every turn may keep its role or be relabelled, be merged into the turn before it
(same role), or be preceded by empty turns; each has a cost. Dynamic programming over the automaton's
four states (start, system, user, assistant) finds the cheapest sequence, which is then rendered.

Scale: a conversation of up to `whole` turns is repaired and rendered in one piece; conversations are dealt by their id. Only a
longer one is cut, into parts of `whole` consecutive turns (part 0, 1, ..., whose texts follow on one another): its rows
are range-partitioned by their order, and a row's place follows from the sizes of the ranges before its own, so the parts
don't depend on how many partitions there are. A part's effect is a 4 x 4 matrix of cheapest costs between
states, and matrices of consecutive parts combine by (min, +) product. With the states at its
edges known, each part is repaired and rendered on its own.

Defined cases: a null or unknown role must be relabelled; null text is empty; turns are ordered by
turn (null last), role, text, so repeated rows and ties have an order; rows with null conv_id are one
conversation; an empty table gives an empty result; other columns are ignored; marker brackets inside texts
are broken up by a space.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, release, small_batches

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: Roles that may follow each state, by number in ROLES; a role's state is its number + 1.
NEXT = {START: (0, 1), SYSTEM: (1,), USER: (2,), ASSISTANT: (1,)}
INF = float("inf")


class Repair:
    """The moves of the automaton: for every role class (3: unknown) and pair of states the cheapest way to take a turn."""

    def __init__(self, merge: float = 1.0, relabel: float = 4.0, insert: float = 2.0, last: tuple[str, ...] = ("assistant",)):
        self.insert = insert
        self.last = [ROLES.index(r) + 1 for r in last]
        self.paths = {(s, t): self._inserted(s, t) for s in range(4) for t in range(4)}
        self.move: list[dict[tuple[int, int], tuple[float, tuple]]] = []
        for role in range(4):
            best: dict[tuple[int, int], tuple[float, tuple]] = {}
            for s in range(4):
                for new in range(3):
                    label = 0.0 if new == role else relabel
                    options = [(label + merge, ("merge", new, ()))] if s == new + 1 else []
                    for mid in range(4):
                        path = self.paths[s, mid]
                        if path is not None and new in NEXT[mid]:
                            options.append((label + insert * len(path), ("add", new, path)))
                    for cost, how in options:
                        key = (s, new + 1)
                        if key not in best or cost < best[key][0]:
                            best[key] = (cost, how)
            self.move.append(best)

    @staticmethod
    def _inserted(s: int, t: int) -> tuple[int, ...] | None:
        """Fewest empty turns that lead from s to t."""
        for n in range(4):
            for path in itertools.product(range(3), repeat=n):
                at = s
                for r in path:
                    if r not in NEXT[at]:
                        break
                    at = r + 1
                else:
                    if at == t:
                        return path
        return None

    def end(self, s: int) -> tuple[float, tuple[int, ...]]:
        """Cost of ending in state s, and the empty turns for it; an empty conversation is legal."""
        if s == START or s in self.last:
            return 0.0, ()
        found = [(self.insert * len(p), p) for t in self.last if (p := self.paths[s, t]) is not None]
        return min(found, default=(INF, ()), key=lambda x: x[0])

    def matrix(self, roles: list[int]) -> np.ndarray:
        """Cheapest cost from each state to each state over the turns."""
        m = np.full((4, 4), INF)
        np.fill_diagonal(m, 0.0)
        for r in roles:
            step = np.full((4, 4), INF)
            for (s, t), (cost, _) in self.move[r].items():
                step[s, t] = cost
            m = (m[:, :, None] + step[None]).min(axis=1)
        return m

    def best(self, roles: list[int], begin: int = START, finish: int | None = None) -> tuple[float, list[tuple], tuple[int, ...]]:
        """(cost, how each turn is taken, empty turns at the end). finish: the state to end in, None for a legal end."""
        cost = [INF] * 4
        cost[begin] = 0.0
        back = []
        for r in roles:
            new, via = [INF] * 4, [None] * 4
            for (s, t), (c, how) in self.move[r].items():
                if cost[s] + c < new[t]:
                    new[t], via[t] = cost[s] + c, (s, how)
            cost = new
            back.append(via)
        if finish is None:
            ends = [(cost[s] + self.end(s)[0], s) for s in range(4)]
            total, s = min(ends)
            tail = self.end(s)[1]
        else:
            total, s, tail = cost[finish], finish, ()
        steps = []
        for via in reversed(back):
            s, how = via[s]
            steps.append(how)
        return total, steps[::-1], tail

    def chain(self, matrices: list[np.ndarray]) -> list[tuple[int, int | None]]:
        """(begin, finish) states of consecutive segments of one conversation; the last one's finish is None."""
        cost = np.full(4, INF)
        cost[START] = 0.0
        back = []
        for m in matrices:
            both = cost[:, None] + m
            back.append(both.argmin(axis=0))
            cost = both.min(axis=0)
        s = min(range(4), key=lambda x: (cost[x] + self.end(x)[0], x))
        states = [s]
        for b in reversed(back):
            states.append(int(b[states[-1]]))
        states.reverse()
        return [(states[i], states[i + 1] if i + 1 < len(matrices) else None) for i in range(len(matrices))]


def render(steps: list[tuple], tail: tuple[int, ...], texts: list[str], first: bool, last: bool) -> tuple[str, int, int, int]:
    """(text, turns, merges, insertions): a turn's end is written by what follows it."""
    out, turns, merges, inserts = [], 0, 0, 0

    def turn(role: int, text: str) -> None:
        nonlocal turns
        out.append(("" if first and not turns else "<|end|>\n") + f"<|{ROLES[role]}|>\n{text}")
        turns += 1

    for (kind, role, path), text in zip(steps, texts, strict=True):
        text = text.replace("<|", "< |")
        if kind == "merge":
            out.append("\n\n" + text)
            merges += 1
            continue
        for r in path:
            turn(r, "")
        inserts += len(path)
        turn(role, text)
    for r in tail:
        turn(r, "")
    inserts += len(tail)
    if last and (turns or not first):
        out.append("<|end|>\n")
    return "".join(out), turns, merges, inserts


def role_class(role: str | None) -> int:
    role = (role or "").strip().lower()
    return ROLES.index(role) if role in ROLES else 3


def _pieces(batches):
    """((part, conv_id), roles, texts) of consecutive rows."""
    key, roles, texts = None, [], []
    for batch in batches:
        for part, conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (part, conv) != key:
                if roles:
                    yield key, roles, texts
                key, roles, texts = (part, conv), [], []
            roles.append(role_class(role))
            texts.append(text or "")
    if roles:
        yield key, roles, texts


def _summaries(batches, repair: Repair):
    for (part, conv), roles, _ in _pieces(batches):
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([conv], pa.int64()), pa.array([repair.matrix(roles).ravel().tolist()], pa.list_(pa.float64()))], names=["part", "conv_id", "m"]
        )


def _chained(batches, repair: Repair):
    """(conv_id, part, begin, finish, count) of the parts of a long conversation, which come in order; 16 numbers a part."""
    for _, group in itertools.groupby((x for b in batches for x in b.to_pylist()), key=lambda x: x["conv_id"]):
        group = list(group)
        states = repair.chain([np.array(x["m"]).reshape(4, 4) for x in group])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([x["conv_id"] for x in group], pa.int64()),
                pa.array([x["part"] for x in group], pa.int32()),
                pa.array([s for s, _ in states], pa.int32()),
                pa.array([f for _, f in states], pa.int32()),
                pa.array([len(group)] * len(group), pa.int32()),
            ],
            names=["conv_id", "part", "begin", "finish", "count"],
        )


_NAMES = ["conv_id", "part", "n_turns", "cost", "n_merged", "n_relabelled", "n_inserted", "text"]


def _formatted(batches, repair: Repair):
    """Rows of (part, conv_id, role, text, begin, finish, count), a piece's together, to one row a piece."""
    edges: dict = {}

    def split():
        for batch in batches:
            for part, conv, begin, finish, count in {x for x in zip(*(batch.column(i).to_pylist() for i in (0, 1, 4, 5, 6)), strict=True)}:
                edges[part, conv] = begin, finish, count
            yield batch

    rows, size = [], 0

    def flush():
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=_NAMES)

    for (part, conv), roles, texts in _pieces(split()):
        begin, finish, count = edges.pop((part, conv))
        cost, steps, tail = repair.best(roles, START if begin is None else begin, finish)
        text, turns, merges, inserts = render(steps, tail, texts, part == 0, part == (count or 1) - 1)
        changed = sum(new != role for (_, new, _), role in zip(steps, roles, strict=True))
        rows.append((conv, part, turns, cost, merges, changed, inserts, text))
        size += len(text)
        if size > 1 << 22 or len(rows) >= 4096:
            yield flush()
            rows, size = [], 0
    if rows:
        yield flush()


class ChatFormat:
    """whole: turns of the longest conversation that stays in one piece."""

    def __init__(self, repair: Repair | None = None, whole: int = 1024):
        self.repair, self.whole = repair or Repair(), whole

    def format(self, conversations: DataFrame) -> DataFrame:
        """conv_id, part, n_turns, cost, n_merged, n_relabelled, n_inserted, text."""
        repair, whole = self.repair, self.whole
        small_batches(conversations.sparkSession, 4096)
        order = [F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last()]
        rows = conversations.select("conv_id", "turn", "role", "text")
        # Long ones only: fewer than rows / whole, so AQE broadcasts them unless they are very many.
        long_ = durable(rows.groupBy("conv_id").count().where(F.col("count") > whole).select(F.col("conv_id").alias("__id")), "chat-long")
        same = F.col("conv_id").eqNullSafe(F.col("__id"))
        short = rows.join(long_, same, "left_anti").withColumn("part", F.lit(0))
        edge = [F.lit(None).cast("int").alias(c) for c in ("begin", "finish", "count")]
        columns = ["part", "conv_id", "role", "text", "begin", "finish", "count"]
        by = lambda df: df.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", *order)
        pieces = by(short).select("part", "conv_id", "role", "text", *edge)
        if long_.take(1):
            # The place of a row in its conversation: those of its id in earlier ranges, and its place in its own.
            # Equal rows change nothing by changing places.
            ranged = rows.join(long_, same, "left_semi").repartitionByRange(F.col("conv_id").asc_nulls_last(), *order, F.monotonically_increasing_id())
            ranged = durable(ranged.withColumn("span", F.spark_partition_id()), "chat-ranged")
            before = F.sum("n").over(W.partitionBy("conv_id").orderBy("span").rowsBetween(W.unboundedPreceding, -1))
            per = ranged.groupBy("conv_id", "span").agg(F.count("*").alias("n")).select(F.col("conv_id").alias("__id"), F.col("span").alias("__span"), F.coalesce(before, F.lit(0)).alias("offset"))
            place = F.row_number().over(W.partitionBy("conv_id", "span").orderBy(*order)) - 1
            placed = ranged.withColumn("place", place).join(per, same & (F.col("span") == F.col("__span")))
            placed = placed.withColumn("part", F.floor((F.col("place") + F.col("offset")) / whole).cast("int"))
            placed = durable(placed.select("conv_id", "turn", "role", "text", "part"), "chat-placed")
            release(ranged)
            found = by(placed).select("part", "conv_id", "role", "text").mapInArrow(lambda it: _summaries(it, repair), "part int, conv_id long, m array<double>")
            states = found.repartition("conv_id").sortWithinPartitions("conv_id", "part").select("conv_id", "part", "m")
            states = states.mapInArrow(lambda it: _chained(it, repair), "conv_id long, part int, begin int, finish int, count int")
            states = durable(states.select(F.col("conv_id").alias("__id"), F.col("part").alias("__part"), "begin", "finish", "count"), "chat-states")
            known = placed.join(states, same & (F.col("part") == F.col("__part")))
            pieces = pieces.unionByName(by(known).select(*columns))
        return pieces.select(*columns).mapInArrow(
            lambda it: _formatted(it, repair),
            "conv_id long, part int, n_turns long, cost double, n_merged long, n_relabelled long, n_inserted long, text string",
        )
