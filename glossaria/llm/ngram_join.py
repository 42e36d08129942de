"""N-gram Jaccard self-join: rare-first prefix filtering with length, positional and suffix filters.

A document's set is its distinct 5-word shingles (64-bit hashes). Two documents link when
100 * |A & B| >= 80 * |A | B|. The steps:

1. One pass over the texts gives each document's set size and signature, and counts the shingles of
   all documents in a table of fixed size (2^20 counters). Documents with equal sets become one class.
2. A second pass orders each set by (counter, hash), rarest first, and keeps the prefix of
   n - ceil(0.8 n) + 1 shingles: two sets that link share one of them. Any fixed order is
   exact; counters that share shingles only make it a little less selective.
3. Prefix shingles held by several classes are found by a min / max aggregation. Each class first
   meets the smallest class of each of its shingles (the leader), so a group of g near copies makes
   in the order of g pairs, not g^2. Pairs pass the length filter, the positional filter (shingles
   left after the first common one) and the suffix filter (shingles in each of 64 hash ranges
   bound the overlap), then both sets are intersected once.
4. Only shingles that still join classes of different components are paired in full; pairs within a
   component can't change the result. Members are paired by buckets of equal size and position, and only buckets that the length and
   positional filters admit meet. That makes the components exact.

No pair, link or component goes to the driver; the broadcast tables have fixed sizes (4 MB of
counters; a Bloom filter of at most 32 MB that spares shuffling texts and only ever lets too much through).

Defined cases: null text, and text without words, has an empty set and links with nothing; rows
that share a doc_id count as one document; a row with null doc_id keeps a null component; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import components, durable, lean, release, small_batches, spread_join

_SLICES = 64
_HASHES = 4


def prefix_length(n, num: int, den: int):
    """Shingles of a set of n that must include a common one: n - ceil(t n) + 1."""
    return n - (num * n + den - 1) // den + 1


def _scan(batches, bits: int, k: int):
    counts = np.zeros(1 << bits, np.uint32)
    for batch in batches:
        ids = batch.column(0)
        for i, j, buf, off in tk.slices(batch.column(1)):
            s, edge = tk.shingle_sets(buf, off, k)
            np.add.at(counts, (s >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
            n = np.diff(edge)
            sig = []
            for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tk.mix(s ^ np.uint64(salt)), dtype=np.uint64)])
                sig.append((total[edge[1:]] - total[edge[:-1]]).view(np.int64))
            m = j - i
            yield pa.RecordBatch.from_arrays(
                [ids[i:j], pa.array(n, pa.int64()), pa.array(sig[0]), pa.array(sig[1]), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())],
                names=["doc_id", "n", "s1", "s2", "part", "counts"],
            )
    if counts.any():
        rows = [x.astype("<u4").tobytes() for x in np.split(counts, _SLICES)]
        none = pa.nulls(_SLICES, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, none, none, none, pa.array(range(_SLICES), pa.int32()), pa.array(rows, pa.binary())],
            names=["doc_id", "n", "s1", "s2", "part", "counts"],
        )


def _add_up(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(counts, "<u4").astype(np.uint64)
            total[part] = total[part] + x if part in total else x
    for part, x in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([np.minimum(x, 0xFFFFFFFF).astype("<u4").tobytes()], pa.binary())], names=["part", "counts"]
        )


def _prefixes(batches, shared, copies, bits: int, k: int, num: int, den: int):
    counts = np.frombuffer(shared.value, "<u4").astype(np.uint64)
    bitmap = np.frombuffer(copies.value, np.uint64)
    low = np.uint64(0xFFFFFFFF)
    for batch in batches:
        ids = batch.column(0)
        for i, j, buf, off in tk.slices(batch.column(1)):
            s, edge = tk.shingle_sets(buf, off, k)
            n = np.diff(edge)
            keep = np.where(n > 0, prefix_length(n, num, den), 0)
            local = (np.arange(len(s)) - np.repeat(edge[:-1], n)).astype(np.uint64)
            key = (counts[(s >> np.uint64(64 - bits)).astype(np.int64)] << np.uint64(32)) | local
            out = []
            for a, b, p in zip(edge[:-1].tolist(), edge[1:].tolist(), keep.tolist(), strict=True):
                if p:
                    q = key[a:b]
                    q.sort()
                    out.append(s[a:b][(q[:p] & low).astype(np.int64)])
            flat = np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)
            ends = np.concatenate([[0], np.cumsum(keep)])
            hist = np.bincount(np.repeat(np.arange(j - i), n) * 64 + (s >> np.uint64(58)).astype(np.int64), minlength=(j - i) * 64)
            yield pa.RecordBatch.from_arrays(
                [
                    ids[i:j],
                    pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                    pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * 64, pa.int32()), pa.array(hist, pa.int32())),
                    pa.array(_in_filter(np.nan_to_num(ids[i:j].to_numpy(zero_copy_only=False)).astype(np.int64), bitmap)),
                ],
                names=["doc_id", "n", "prefix", "hist", "doubt"],
            )


def _in_filter(ids: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    found = np.ones(len(ids), bool)
    for j in range(_HASHES):
        at = tk.mix(ids.astype(np.uint64) * np.uint64(2 * j + 3) + np.uint64(j)) & np.uint64(len(bitmap) * 64 - 1)
        found &= (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return found


def _filter_words(batches, bits: int):
    """(word, bits) of a Bloom filter of 2^bits bits over the ids of a partition."""
    bitmap = np.zeros((1 << bits) >> 6, np.uint64)
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for j in range(_HASHES):
            at = tk.mix(ids.astype(np.uint64) * np.uint64(2 * j + 3) + np.uint64(j)) & np.uint64((1 << bits) - 1)
            np.bitwise_or.at(bitmap, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    set_ = np.flatnonzero(bitmap)
    for i in range(0, len(set_), 1 << 16):
        part = set_[i : i + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(bitmap[part].view(np.int64))], names=["word", "bits"])


def _bloom(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of 16 bits an id, 2^28 bits at most: a fuller one lets more through, and exact joins follow."""
    width = min(28, max(16, int(16 * ids.count()).bit_length()))
    words = ids.mapInArrow(lambda it: lean(_filter_words(it, width)), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    bitmap = np.zeros((1 << width) >> 6, np.int64)
    found = words.toArrow()
    bitmap[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return bitmap


def _sets(batches, shared, k: int):
    bitmap = np.frombuffer(shared.value, np.uint64)
    for batch in batches:
        ids = batch.column(0)
        numbers = np.nan_to_num(ids.to_numpy(zero_copy_only=False)).astype(np.int64)
        pick = np.flatnonzero(_in_filter(numbers, bitmap) & np.asarray(ids.is_valid()))
        if not len(pick):
            continue
        batch = batch.take(pa.array(pick))
        for i, j, buf, off in tk.slices(batch.column(1)):
            s, edge = tk.shingle_sets(buf, off, k)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[i:j], pa.array([s[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())],
                names=["doc_id", "members"],
            )


def _verify(batches, num: int, den: int):
    for batch in batches:
        a, b, x, y = (batch.column(i) for i in range(4))
        keep = []
        for i in range(len(batch)):
            p, q = np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64)
            if len(p) > len(q):
                p, q = q, p
            if not len(p):
                continue
            at = np.searchsorted(q, p)
            at[at == len(q)] = 0
            both = int((q[at] == p).sum())
            if den * both >= num * (len(p) + len(q) - both):
                keep.append(i)
        if keep:
            yield pa.RecordBatch.from_arrays([a.take(pa.array(keep)), b.take(pa.array(keep))], names=["a", "b"])


class NgramJaccardJoin:
    """k-word shingles, threshold num / den. The prefix, length and overlap bounds follow from the threshold."""

    def __init__(self, k: int = 5, num: int = 80, den: int = 100, bits: int = 20):
        self.k, self.num, self.den, self.bits = k, num, den, bits

    def classes(self, docs: DataFrame) -> tuple[DataFrame, bytes]:
        """Per row doc_id, n, rep (smallest doc_id with an equal set; null if the set is empty); and the counters."""
        small_batches(docs.sparkSession, size=8 << 20)
        k, bits = self.k, self.bits
        scan = durable(
            docs.select("doc_id", "text").mapInArrow(
                lambda it: lean(_scan(it, bits, k)), "doc_id long, n long, s1 long, s2 long, part int, counts binary"
            ),
            "join-scan",
        )
        parts = scan.where("part is not null").select("part", "counts").repartition(_SLICES, "part")
        rows = parts.mapInArrow(_add_up, "part int, counts binary").collect()  # 2^bits counters in all
        table = np.zeros((_SLICES, (1 << bits) // _SLICES), "<u4")
        for x in rows:
            table[x["part"]] = np.frombuffer(x["counts"], "<u4")
        rows = scan.where("part is null").select("doc_id", "n", "s1", "s2")
        full = rows.where("n > 0 and doc_id is not null")
        lead = durable(full.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "join-lead")
        bare = rows.where("n = 0 or doc_id is null").select("doc_id", "n", F.lit(None).cast("long").alias("rep"))  # nothing to look up
        named = spread_join(full, lead, ["n", "s1", "s2"], "copies").select("doc_id", "n", "rep")
        out = durable(named.unionByName(bare), "join-classes")
        release(scan, lead)
        return out, table.tobytes()

    def shared_shingles(self, docs: DataFrame, classes: DataFrame, counters: bytes) -> tuple[DataFrame, DataFrame]:
        """(shingle rows of prefixes that several classes hold, with the leader; suffix histograms of classes)."""
        k, bits, num, den = self.k, self.bits, self.num, self.den
        sc = docs.sparkSession.sparkContext
        shared = sc.broadcast(counters)
        # Documents that are surely their class's representative go on as they are; only those that the
        # filter of copies doubts are joined with the classes, so prefixes of single documents aren't shuffled.
        others = classes.where("doc_id <> rep or doc_id is null or rep is null").select("doc_id")
        copies = sc.broadcast(_bloom(others.where("doc_id is not null")).tobytes())
        pre = docs.select("doc_id", "text").mapInArrow(
            lambda it: lean(_prefixes(it, shared, copies, bits, k, num, den)), "doc_id long, n long, prefix array<long>, hist array<int>, doubt boolean"
        )
        pre = durable(pre, "join-prefix").where("doc_id is not null")
        shared.unpersist()
        copies.unpersist()
        reps = classes.where("doc_id = rep").select(F.col("rep").alias("doc_id")).distinct()
        pre = pre.where("not doubt").unionByName(pre.where("doubt").join(reps, "doc_id", "left_semi"))
        rows = pre.select(F.col("doc_id").alias("rep"), "n", F.posexplode("prefix").alias("pos", "token"))
        several = rows.groupBy("token").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("token", F.col("lo").alias("leader"))
        return durable(rows.join(several, "token"), "join-shared"), pre.select(F.col("doc_id").alias("rep"), "hist")

    def _filtered(self, pairs: DataFrame, hist: DataFrame, earlier: str = "0") -> DataFrame:
        """pairs(a, b, na, nb, pa, pb), one row a common prefix shingle -> distinct (a, b) that pass the three filters.

        earlier: how many common shingles may stand before the first given one (0 if all are given).
        """
        num, den = self.num, self.den
        one = (
            pairs.where(f"{den} * least(na, nb) >= {num} * greatest(na, nb)")
            .groupBy("a", "b")
            .agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.min("pa").alias("pa"), F.min("pb").alias("pb"))
        )
        need = f"{num + den} * ({{}}) >= {num} * (na + nb)"
        one = one.where(need.format(f"{earlier} + least(na - pa, nb - pb)"))
        left = hist.select(F.col("rep").alias("a"), F.col("hist").alias("ha"))
        right = hist.select(F.col("rep").alias("b"), F.col("hist").alias("hb"))
        both = one.join(left, "a").join(right, "b")
        return both.where(need.format("aggregate(zip_with(ha, hb, (x, y) -> least(x, y)), 0, (s, x) -> s + x)")).select("a", "b")

    def links(self, docs: DataFrame, pairs: DataFrame) -> DataFrame:
        """The pairs whose sets link, each verified once."""
        spark, k, num, den = docs.sparkSession, self.k, self.num, self.den
        pairs = durable(pairs, "join-pairs")
        ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
        if not pairs.take(1):
            return pairs
        shared = spark.sparkContext.broadcast(_bloom(ids).tobytes())
        sets = docs.select("doc_id", "text").mapInArrow(lambda it: lean(_sets(it, shared, k)), "doc_id long, members binary")
        sets = durable(sets, "join-sets")
        shared.unpersist()
        one = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("members").alias("y")), "b")
        both = one.join(sets.select(F.col("doc_id").alias("a"), F.col("members").alias("x")), "a").select("a", "b", "x", "y")
        found = durable(both.mapInArrow(lambda it: lean(_verify(it, num, den)), "a long, b long").distinct(), "join-links")
        release(sets, pairs)
        return found

    def groups(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_shingles, component_id for every row."""
        classes, counters = self.classes(docs)
        shared, hist = self.shared_shingles(docs, classes, counters)
        lead = shared.where("rep = leader").select("token", F.col("n").alias("na"), F.col("pos").alias("pa"))
        met = shared.where("rep <> leader").join(lead, "token").select(
            F.col("leader").alias("a"), F.col("rep").alias("b"), "na", F.col("n").alias("nb"), "pa", F.col("pos").alias("pb")
        )
        links = self.links(docs, self._filtered(met, hist, earlier="least(pa, pb)"))
        comp = components(links)
        # What is left: shingles whose classes are in several components, paired across components only. The members of a shingle's
        # largest component never meet each other, and pairs are held against the length and positional filters as they are made.
        named = shared.join(comp.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
        named = durable(named.select("token", "rep", "n", "pos", "comp"), "join-named")
        per = named.groupBy("token", "comp").agg(F.count("*").alias("members"))
        open_ = per.groupBy("token").agg(F.max_by("comp", F.struct("members", "comp")).alias("largest"), F.count("*").alias("comps")).where("comps > 1")
        rest = durable(named.join(open_.select("token", "largest"), "token"), "join-open")
        # Members of equal size and position are a bucket. Which buckets can hold a link is settled between buckets, before members are
        # paired: a shingle that stands too late in its members' prefixes pairs none of them, however many they are.
        bucket = rest.groupBy("token", "n", "pos").agg(F.max(F.col("comp") != F.col("largest")).alias("other"))
        left = bucket.where("other").select("token", F.col("n").alias("na"), F.col("pos").alias("pa"))
        right = bucket.select("token", F.col("n").alias("nb"), F.col("pos").alias("pb"))
        fit = f"{self.den} * least(na, nb) >= {self.num} * greatest(na, nb) and {self.num + self.den} * least(na - pa, nb - pb) >= {self.num} * (na + nb)"
        meet = durable(left.join(right, "token").where(fit), "join-buckets")
        a = rest.where("comp <> largest").select("token", F.col("rep").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("comp").alias("ca"))
        b = rest.select("token", F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("comp").alias("cb"), "largest")
        more = a.join(meet, ["token", "na", "pa"]).join(b, ["token", "nb", "pb"]).where("ca <> cb and (cb = largest or a < b)").select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
            F.expr("if(a < b, na, nb)").alias("na"), F.expr("if(a < b, nb, na)").alias("nb"), F.expr("if(a < b, pa, pb)").alias("pa"), F.expr("if(a < b, pb, pa)").alias("pb"),
        )
        tried = met.select("a", "b").distinct()
        more = self._filtered(more, hist).join(tried, ["a", "b"], "left_anti")
        new = self.links(docs, more)
        if new.take(1):
            comp = components(links.unionByName(new))
        release(named, rest, meet, shared, *([] if new.take(1) else [new]))
        copies = classes.where("rep is not null").groupBy("rep").agg(F.count("*").alias("copies"))
        found = durable(copies.join(comp.withColumnRenamed("id", "rep"), "rep", "left"), "join-found")
        label = spread_join(classes.where("rep is not null"), found, ["rep"], "copies")
        bare = classes.where("rep is null").withColumn("component", F.lit(None).cast("long"))
        label = label.select("doc_id", "n", "rep", "component").unionByName(bare.select("doc_id", "n", "rep", "component"))
        return label.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))

    def one_of_each(self, docs: DataFrame) -> DataFrame:
        """The rows of docs without those whose component has a smaller doc_id; all columns kept.

        Only the ids that go or repeat are joined, against a Bloom filter's suspects: the texts of the others are not shuffled.
        Of rows that share a doc_id the first by text, then by the hash of the whole row, stays; rows with null doc_id stay.
        """
        groups = self.groups(docs).where("doc_id is not null")
        per = groups.groupBy("doc_id").agg(F.max(F.col("doc_id") != F.col("component_id")).alias("gone"), F.count("*").alias("rows"))
        found = durable(per.where("gone or rows > 1").select(F.col("doc_id").alias("__id"), "gone"), "join-gone")
        shared = docs.sparkSession.sparkContext.broadcast(_bloom(found.select(F.col("__id").alias("doc_id"))).tobytes())
        at = docs.columns.index("doc_id")

        def part(batches, sure: bool):
            bitmap = np.frombuffer(shared.value, np.uint64)
            for batch in batches:
                ids = batch.column(at)
                hit = _in_filter(np.nan_to_num(ids.to_numpy(zero_copy_only=False)).astype(np.int64), bitmap) & np.asarray(ids.is_valid())
                yield batch.filter(pa.array(~hit if sure else hit))

        clear = docs.mapInArrow(lambda it: lean(part(it, True)), docs.schema)
        doubt = docs.mapInArrow(lambda it: lean(part(it, False)), docs.schema)
        left = doubt.join(found.where("gone"), F.col("doc_id") == F.col("__id"), "left_anti")
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        first = left.groupBy("doc_id").agg(F.min_by(whole, F.struct("text", F.xxhash64(whole))).alias("__row"))
        return clear.unionByName(first.select(*[F.col(f"__row.`{c}`").alias(c) for c in docs.columns]))
