"""N-gram Jaccard join: documents whose word shingles overlap, and the components of those links.

Jaccard distance is a metric, so pivots can split the space into regions:

1. **Sets.** A document's set is its distinct ``words``-word shingles, as 64-bit hashes. Equal sets
   are one class; only its smallest doc_id goes on.
2. **Pivots and regions.** Two linked sets must share more than e of the smallest
   ``n - ceil(0.8 n) + 1 + e`` hashes of each (fewer shared than that cannot reach the similarity). The
   smallest doc_id of about the same size that holds such a shingle is its pivot, and holders are
   replicated into the pivot's region, border documents into several. A set of whose small hashes no more
   than e have other holders has no links. Any other one leaves the regions it shares least with, as long as
   it gives up less than half of e shingles: then two ends of a link still have a region in common. By the triangle inequality
   against the empty set, sizes of a link differ by a fifth at most: holders are replicated over
   neighbouring size windows. So both ends of every link meet in a region. A region over
   ``REGION_ROWS`` members is dealt in parts, its pivot to each.
3. **Distances.** In a region, the shared small hashes bound each member's distance to the pivot
   from below; what the bound leaves is compared exactly. Members within the radius of the pivot
   are one component with it.
4. **Recursion.** Members that the bound keeps from the pivot take their turn as pivots of the rest.
   Where members of different components may still be near, each is compared with those it shares
   most with, in parts dealt anew. Then outsiders of a region's largest component meet all its members
   in pairs of parts, and whole sets of the members that are still in doubt are dealt in blocks of bounded
   size, outsiders of a region's largest component against all, and a task returns only the links
   that join components, never the pairs.

A link is exact: 100 * intersection >= 80 * union over the whole sets. No pair is dropped or capped.
A null text or one without words has an empty set and no links. Rows that share a doc_id are one
node, rows without one take no part; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import components, hand_back, plain_rows, text_steps, utf8, written
from tessera.llm.shingles import shingle_sets

WORDS = 5
PERCENT = 80
#: Small hashes beyond those of which two linked sets share one, in percent of a set.
SPARE = 10
#: Members that are compared with one copy of their pivot in a task.
CHUNK = 256
#: Partners that a member outside its region's largest component is compared with before whole sets are.
NEXT_PAIRS = 3
#: Members of a region that a part of it holds; a task's group is one part, or two.
REGION_ROWS = 1024
#: Shingles of a block of whole sets; a task holds two blocks at a time (a longer set is one alone).
BLOCK_SHINGLES = 1 << 21


def needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The smallest intersection of sets of n and m that is a link: 100 i >= percent (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


# ---------------------------------------------------------------- 1. sets


def small_size(n: int, percent: int) -> int:
    """How many of a set's hashes are its small ones."""
    return min(n, n - -(-percent * n // 100) + 1 + SPARE * n // 100)


def surely_shared(n: Column, percent: int) -> Column:
    """Any set that is linked with one of n hashes shares more than so many small hashes with it."""
    return F.floor(F.ceil(n * percent / 100) * SPARE / 100)


def _sets(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in text_steps(batches):
            found = shingle_sets(*utf8(step.column(1)), words)
            n = np.array([len(x) for x in found], np.int64)
            small = [x[: small_size(len(x), percent)] for x in found]
            with np.errstate(over="ignore"):
                one = [int(x.sum(dtype=np.uint64).astype(np.int64)) for x in found]
                two = [int(np.bitwise_xor.reduce(x * np.uint64(0xC2B2AE3D27D4EB4F) ^ (x >> np.uint64(29))).astype(np.int64)) if len(x) else 0 for x in found]
            yield pa.RecordBatch.from_arrays(
                [step.column(0), pa.array(n), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array([x.tobytes() for x in small], pa.binary())],
                ["doc_id", "n", "k1", "k2", "small"],
            )

    return run


# ---------------------------------------------------------------- 2. pivots and regions


def size_class(n: np.ndarray, percent: int) -> np.ndarray:
    """Sizes that a link can join are in one class or in neighbouring ones."""
    return np.floor(np.log(n) / np.log(100 / percent * 1.0001)).astype(np.int64) if percent < 100 else n


def _deal(buckets: int):
    """Blocks of (hash, doc, size) by bucket: one row for each bucket and step, not one for each hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for step in text_steps(batches, "small"):
            raw, off = utf8(step.column(2))
            h = np.frombuffer(raw.tobytes(), np.uint64)
            size = np.diff(off) // 8
            doc, n = np.repeat(step.column(0).to_numpy(), size), np.repeat(step.column(1).to_numpy().astype(np.int32), size)
            bucket = (h % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            names, begin = np.unique(bucket[order], return_index=True)
            cuts = [order[a:b] for a, b in zip(begin, np.append(begin[1:], len(order)))]
            columns = [pa.array([x[c].tobytes() for c in cuts], pa.binary()) for x in (h, doc, n)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), *columns], ["bucket", "h", "doc", "n"])

    return run


def _elect(percent: int):
    """(x, p, mass, held): x holds ``mass`` hashes whose smallest holder of about its size is p; ``held`` of all have other holders."""

    def out(held: list[tuple]) -> pa.RecordBatch:
        h, doc, n = (np.frombuffer(b"".join(x[i] for x in held), t) for i, t in enumerate((np.uint64, np.int64, np.int32)))
        order = np.argsort(h, kind="stable")
        s = h[order]
        fresh = np.append(True, s[1:] != s[:-1])
        many = np.repeat(np.diff(np.append(np.flatnonzero(fresh), len(s))) > 1, np.diff(np.append(np.flatnonzero(fresh), len(s))))
        order = order[many]
        h, doc, kind = h[order], doc[order], size_class(n[order], percent)
        once = len(h)
        h, doc, kind = np.tile(h, 2), np.tile(doc, 2), np.concatenate([kind, kind + 1])
        order = np.lexsort((doc, kind, h))
        h, doc, kind = h[order], doc[order], kind[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (kind[1:] != kind[:-1])
        group = np.cumsum(fresh) - 1
        pivot = doc[np.flatnonzero(fresh)][group]
        # A holder's hash counts once, though it is in two windows of sizes.
        shared = np.zeros(2 * once, bool)
        shared[order] = np.bincount(group, minlength=1)[group] > 1
        counted = np.concatenate([shared[:once], shared[once:] & ~shared[:once]])[order]
        shared, other = shared[order], pivot != doc
        pairs, which = np.unique(np.stack([doc[shared], pivot[shared]], 1), axis=0, return_inverse=True)
        sums = [np.bincount(which.ravel(), x[shared], len(pairs)).astype(np.int64) for x in (other, counted)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (pairs[:, 0], pairs[:, 1], *sums)], ["x", "p", "mass", "held"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, *arrays in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if bucket != now and held:
                    yield out(held)
                    held = []
                now = bucket
                held.append(tuple(arrays))
        if held:
            yield out(held)

    return run


def worth_visiting(held: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The regions (x, p) that are left of held (x, p, mass, held), so that both ends of every link still meet in one.

    Linked sets share more small hashes than ``surely_shared`` of either, and each end gives up half of that at most.
    """
    each = held.groupBy("x", "p").agg(F.sum("mass").alias("mass"), F.sum("held").alias("held")).join(sizes, F.col("x") == F.col("doc_id"))
    of, shared = Window.partitionBy("x"), surely_shared(F.col("n"), percent)
    each = each.withColumn("all", F.sum("held").over(of)).withColumn("given", F.sum("mass").over(of.orderBy("mass", "p").rowsBetween(Window.unboundedPreceding, 0)))
    return each.where((F.col("all") > shared) & (F.col("given") > F.floor(shared / 2)) & (F.col("x") != F.col("p"))).select("x", "p")


def _halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n, small) with the upper halves of the hashes: equal hashes stay equal, so bounds stay bounds."""
    for batch in batches:
        raw, off = utf8(batch.column(2))
        upper = (np.frombuffer(raw.tobytes(), np.uint64) >> np.uint64(32)).astype(np.uint32).tobytes()
        small = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((off // 2).astype(np.int32).tobytes()), pa.py_buffer(upper)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), small], ["doc_id", "n", "small"])


# ---------------------------------------------------------------- 3., 4. regions


class _Region:
    """The members of one region: ids, set sizes, small hashes (upper halves) and components."""

    def __init__(self, ids: list[int], sizes: list[int], small: list[bytes], comp: list[int]):
        self.ids, self.n, self.comp = np.array(ids, np.int64), np.array(sizes, np.int64), np.array(comp, np.int64)
        self.off = np.cumsum([0, *(len(x) // 4 for x in small)])
        self.h = np.frombuffer(b"".join(small), np.uint32)
        self.owner = np.repeat(np.arange(len(ids)), np.diff(self.off))
        self.key = (self.owner.astype(np.uint64) << np.uint64(32)) | self.h  # ascending: members in turn, each one's hashes sorted
        order = np.argsort(self.h, kind="stable")
        self.sorted, self.holder = self.h[order], self.owner[order]
        self.last = self.h[self.off[1:] - 1]
        self.sizes = np.diff(self.off)

    def possible(self, y: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Members whose link with y the shared small hashes don't rule out, and how many of these they share."""
        mine = self.h[self.off[y] : self.off[y + 1]]
        a, b = np.searchsorted(self.sorted, mine, "left"), np.searchsorted(self.sorted, mine, "right")
        at = np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange((b - a).sum())
        shared = np.bincount(self.holder[at], minlength=len(self.n))
        shared[y] = 0
        who = np.flatnonzero(shared)
        n, common, last = self.n[who], shared[who], self.last[who]
        want = needed(n, self.n[y], percent)
        # What lies above the lower of the two last small hashes may all be shared; nothing else.
        rest_y = self.n[y] - np.searchsorted(mine, np.minimum(last, self.last[y]), "right")
        rest = np.where(last <= self.last[y], n - self.sizes[who], n)
        keep = (np.minimum(n, self.n[y]) >= want) & (common + np.minimum(rest_y, rest) >= want)
        who, common, want, rest_y = who[keep], common[keep], want[keep], rest_y[keep]
        upto = (who.astype(np.uint64) << np.uint64(32)) | np.uint64(self.last[y])
        below = np.searchsorted(self.key, upto, "right") - self.off[who]
        keep = common + np.minimum(rest_y, self.n[who] - below) >= want
        return who[keep], common[keep]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[list]]]:
    """(key, the other columns' values) of each run of rows that agree in the first ``keys`` columns."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            if row[:keys] != now and held:
                yield now, [list(x) for x in zip(*held)]
                held = []
            now = row[:keys]
            held.append(row[keys:])
    if held:
        yield now, [list(x) for x in zip(*held)]
    del held
    hand_back()


def _each_region(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, _Region]]:
    """(pivot, whether the region is whole, members) of each region or part of one."""
    for (p, _, parts), columns in _groups(batches, 3):
        yield p, parts == 1, _Region(*columns)


def _rows_of(pairs: tuple[list, list], stay: list[int], open_: bool, p: int) -> pa.RecordBatch:
    """Rows (a, b, p) of pairs, (a, null, p) of members that stay for later rounds, and (null, null, p) of an open region."""
    a, b = np.array(pairs[0], np.int64), np.array(pairs[1], np.int64)
    high = pa.concat_arrays([pa.array(np.maximum(a, b)), pa.array(stay, pa.int64()), pa.nulls(int(open_), pa.int64())])
    low = pa.concat_arrays([pa.array(np.minimum(a, b)), pa.nulls(len(stay) + int(open_), pa.int64())])
    return pa.RecordBatch.from_arrays([high, low, pa.array(np.full(len(high), p, np.int64))], ["a", "b", "p"])


def _first_pairs(percent: int):
    """Each member with a pivot it may be near: the region's, or else the first that nobody else was near to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, whole, region in _each_region(batches):
            at = int(np.searchsorted(region.ids, p))
            free, stay = np.ones(len(region.ids), bool), np.zeros(len(region.ids), bool)
            left, right, more, stars = [], [], False, 0
            for y in [at, *(i for i in range(len(region.ids)) if i != at)]:
                # Members that have a pivot don't become one here; whom else they may be near is seen later.
                if not free[y]:
                    continue
                free[y] = False
                who, _ = region.possible(y, percent)
                near = who[free[who]]
                stay[y] |= len(who) > 0
                stay[who] = True
                more |= len(near) < len(who)
                stars += len(near) > 0
                free[near] = False
                left += [int(region.ids[y])] * len(near)
                right += region.ids[near].tolist()
            # Members of two stars may be near each other though their pivots aren't. A member that
            # may be near to none is settled, if the region is whole.
            stay |= not whole
            yield _rows_of((left, right), region.ids[stay].tolist(), more or stars > 1 or not whole, p)

    return run


def _in_doubt(region: _Region, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each member outside the largest component, with those of other components it may be near to, and what they share."""
    names, counts = np.unique(region.comp, return_counts=True)
    for y in np.flatnonzero(region.comp != names[counts.argmax()]).tolist():
        who, common = region.possible(y, percent)
        other = region.comp[who] != region.comp[y]
        if other.any():
            yield y, who[other], common[other]


def _later_pairs(percent: int, most: int):
    """Members of different components that may be near; for each the ``most`` with the most in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, _, region in _each_region(batches):
            left, right = [], []
            for y, who, common in _in_doubt(region, percent):
                who = who[np.argsort(-common, kind="stable")[:most]]
                left += [int(region.ids[y])] * len(who)
                right += region.ids[who].tolist()
            yield _rows_of((left, right), [], False, p)

    return run


def _doubtful(percent: int):
    """Rows (p, i, j, member, x, n, small, comp, out): outsiders (member = 0) and members of other components that may be near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (p, _, _), (member, ids, sizes, small, comp, out) in _groups(batches, 3):
            region, member = _Region(ids, sizes, small, comp), np.array(member, bool)
            open_ = np.zeros(len(ids), bool)
            for y in np.flatnonzero(~member).tolist():
                who, _ = region.possible(y, percent)
                other = who[member[who] & (region.comp[who] != region.comp[y])]
                open_[y] |= len(other) > 0
                open_[other] = True
            at = np.flatnonzero(open_)
            columns = [region.ids[at], np.full(len(at), p, np.int64), region.comp[at], np.array(out, bool)[at], region.n[at]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["x", "p", "comp", "out", "n"])

    return run


def _joining_links(held: list[tuple], percent: int) -> pa.RecordBatch:
    """Of (member, doc, comp, set) in two blocks: links of outsiders (member = 0) with members that join their components."""
    inside = [x for x in held if x[0]]
    a, b = [], []
    if inside:
        ids, sizes = np.array([x[1] for x in inside], np.int64), np.array([len(x[3]) for x in inside], np.int64)
        label = np.array([x[2] for x in inside], np.int64)
        hashes, owner = np.concatenate([x[3] for x in inside]), np.repeat(np.arange(len(inside)), sizes)
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], owner[order]
        moved: dict[int, int] = {}
        for _, doc, comp, mine in (x for x in held if not x[0]):
            while comp in moved:
                comp = moved[comp]
            first, last = np.searchsorted(hashes, mine, "left"), np.searchsorted(hashes, mine, "right")
            count = last - first
            at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
            shared = np.bincount(owner[at], minlength=len(ids))
            linked = np.flatnonzero((shared >= needed(sizes, len(mine), percent)) & (label != comp))
            for other, k in zip(*np.unique(label[linked], return_index=True)):
                a.append(doc)
                b.append(int(ids[linked[k]]))
                moved[int(other)] = comp
                label[label == other] = comp
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _compare_blocks(words: int, percent: int):
    """Rows (p, i, j, member, doc, comp, text) in the order of p, i, j: a link for each join of two components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for step in text_steps(batches):
            found = shingle_sets(*utf8(step.column(6)), words)
            for p, i, j, member, doc, comp, mine in zip(*(step.column(k).to_pylist() for k in range(6)), found):
                if (p, i, j) != now and held:
                    yield _joining_links(held, percent)
                    held = []
                now = p, i, j
                held.append((member, doc, comp, mine))
        if held:
            yield _joining_links(held, percent)

    return run


def _compare(words: int, percent: int):
    """Rows (b, salt, member, doc, text), a pivot before its members: the pairs that are links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivot, held = None, np.zeros(0, np.uint64)
        for step in text_steps(batches):
            found = shingle_sets(*utf8(step.column(4)), words)
            a, b = [], []
            for p, member, doc, mine in zip(step.column(0).to_pylist(), step.column(2).to_pylist(), step.column(3).to_pylist(), found):
                if not member:
                    pivot, held = p, mine
                    continue
                small, large = (mine, held) if len(mine) < len(held) else (held, mine)
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                common = int((large[at] == small).sum()) if len(large) else 0
                if p == pivot and 100 * common >= percent * (len(mine) + len(held) - common) and common:
                    a.append(doc)
                    b.append(p)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def verified(pairs: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """The links among the pairs (a, b), by whole sets; a much-paired b is dealt over several tasks."""
    salts = written(pairs.groupBy("b").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("salts")), "salts")
    members = pairs.join(salts, "b").select("b", F.expr("pmod(xxhash64(a), salts)").cast("int").alias("salt"), F.lit(1).alias("member"), F.col("a").alias("doc"))
    pivots = salts.select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("member"), F.col("b").alias("doc"))
    # One join, so that the texts are shuffled once.
    asked = members.unionByName(pivots).join(rows, F.col("doc") == F.col("doc_id")).select("b", "salt", "member", "doc", "text")
    dealt = asked.repartition("b", "salt").sortWithinPartitions("b", "salt", "member")
    return written(dealt.mapInArrow(_compare(words, percent), "a long, b long"), "links")


def links_in_blocks(doubtful: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between components among the members in doubt, by whole sets; each pair of blocks is a task's group."""
    blocks, outs = F.col("blocks"), F.col("out_blocks")
    every = doubtful.select("p", F.explode(F.sequence(F.lit(0).cast("long"), outs - 1)).alias("i"), F.pmod(F.xxhash64("x"), blocks).alias("j"), F.lit(1).alias("member"), "x", "comp")
    outside = doubtful.where("out").select("p", F.pmod(F.xxhash64("x", F.lit(1)), outs).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("j"), F.lit(0).alias("member"), "x", "comp")
    dealt = every.unionByName(outside).join(rows, F.col("x") == F.col("doc_id")).select("p", "i", "j", "member", "x", "comp", "text")
    dealt = dealt.repartition("p", "i", "j").sortWithinPartitions("p", "i", "j")
    return written(dealt.mapInArrow(_compare_blocks(words, percent), "a long, b long"), "links")


def in_doubt(members: DataFrame, small: DataFrame, percent: int, region_rows: int, block: int) -> DataFrame:
    """Of members (x, p, comp, q) of regions with several components, those in doubt, and how many blocks their whole sets make."""
    each = members.select("x", "p", "comp").unionByName(members.select(F.col("p").alias("x"), "p", F.col("q").alias("comp")).distinct())
    counts = each.groupBy("p", "comp").agg(F.count("*").alias("c"))
    main = counts.groupBy("p").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.sum("c").alias("rows"), F.max("c").alias("most"))
    main = main.select("p", "main", F.ceil(F.col("rows") / region_rows).alias("parts"), F.ceil((F.col("rows") - F.col("most")) / region_rows).alias("out_parts"))
    each = each.join(main, "p").withColumn("out", F.col("comp") != F.col("main"))
    zero, parts, outs = F.lit(0).cast("long"), F.col("parts"), F.col("out_parts")
    every = each.select("p", F.explode(F.sequence(zero, outs - 1)).alias("i"), F.pmod(F.xxhash64("x"), parts).alias("j"), F.lit(1).alias("member"), "x", "comp", "out")
    outside = each.where("out").select("p", F.pmod(F.xxhash64("x", F.lit(1)), outs).alias("i"), F.explode(F.sequence(zero, parts - 1)).alias("j"), F.lit(0).alias("member"), "x", "comp", "out")
    dealt = every.unionByName(outside).join(small, F.col("x") == F.col("doc_id")).select("p", "i", "j", "member", "x", "n", "small", "comp", "out")
    dealt = dealt.repartition("p", "i", "j").sortWithinPartitions("p", "i", "j")
    found = written(dealt.mapInArrow(_doubtful(percent), "x long, p long, comp long, out boolean, n long").distinct(), "doubtful")
    number = lambda n: F.greatest(F.lit(1).cast("long"), F.ceil(F.coalesce(n, F.lit(0)) / block))
    blocks = found.groupBy("p").agg(number(F.sum("n")).alias("blocks"), number(F.sum(F.when(F.col("out"), F.col("n")))).alias("out_blocks"))
    return found.join(blocks, "p").select("x", "p", "comp", "out", "blocks", "out_blocks")


def jaccard_links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK_SHINGLES, region_rows: int = REGION_ROWS) -> tuple[DataFrame, DataFrame]:
    """(sets, edges) of docs (doc_id, text): doc_id and n of every row; edges (a, b) that span every component of links."""
    spark = docs.sparkSession
    rows = plain_rows(docs, "doc_id", "text").where("doc_id is not null")
    sets = written(rows.mapInArrow(_sets(words, percent), "doc_id long, n long, k1 long, k2 long, small binary"), "sets")
    full = sets.where("n > 0")
    classes = written(full.groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("b"), F.count("*").alias("size")).where("size > 1").drop("size"), "classes")
    copies = written(full.select("doc_id", "n", "k1", "k2").join(classes, ["n", "k1", "k2"]).where("doc_id <> b").selectExpr("doc_id as a", "b"), "copies")
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = full.select("doc_id", "n", "small").mapInArrow(_deal(buckets), "bucket long, h binary, doc binary, n binary")
    held = blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_elect(percent), "x long, p long, mass long, held long")
    regions = written(worth_visiting(held, full.select("doc_id", "n"), percent).join(copies, F.col("x") == F.col("a"), "left_anti"), "regions")
    small = full.select("doc_id", "n", "small").mapInArrow(_halved, "doc_id long, n long, small binary")

    large = written(regions.groupBy("p").agg(F.ceil(F.count("*") / region_rows).alias("parts")).where("parts > 1"), "large")

    def by_region(members: DataFrame, turn: int) -> DataFrame:
        """Rows (p, part, parts, x, n, small, comp) of members (x, p, comp, q) and pivots, by region and part; each turn deals anew."""
        parts = F.coalesce("parts", F.lit(1).cast("long"))
        dealt = members.join(large, "p", "left").select("p", F.pmod(F.xxhash64("x", F.lit(turn)), parts).alias("part"), parts.alias("parts"), "x", "comp", "q")
        whole = dealt.drop("q").unionByName(dealt.select("p", "part", "parts", F.col("p").alias("x"), F.col("q").alias("comp")).distinct())
        whole = whole.join(small, F.col("x") == F.col("doc_id")).select("p", "part", "parts", "x", "n", "small", "comp")
        return whole.repartition("p", "part").sortWithinPartitions("p", "part", "x")

    none = F.lit(0).cast("long")
    pairs = "a long, b long, p long"
    told = written(by_region(regions.select("x", "p", none.alias("comp"), none.alias("q")), 0).mapInArrow(_first_pairs(percent), pairs), "told")
    near = written(told.where("b is not null").select("a", "b").distinct(), "near")
    links = verified(near, rows, words, percent)
    # Regions that may hold more: a member was near to several, or not so near as it seemed.
    missed = told.where("b is not null").join(links.withColumn("hit", F.lit(1)), ["a", "b"], "left").where("hit is null").select("p")
    open_ = written(told.where("a is null").select("p").unionByName(missed).distinct(), "open")
    inside = written(told.where("a is not null and b is null and a <> p").selectExpr("a as x", "p").join(open_, "p", "left_semi"), "inside")

    def split_regions(links: DataFrame) -> DataFrame:
        """Members, with the components so far, of the open regions that hold more than one component."""
        found = written(components(links), "components").selectExpr("id", "component_id as c")
        marked = inside.join(found, F.col("x") == F.col("id"), "left").select("x", "p", F.coalesce("c", "x").alias("comp"))
        marked = written(marked.join(found, F.col("p") == F.col("id"), "left").select("x", "p", "comp", F.coalesce("c", "p").alias("q")), "marked")
        return written(marked.join(marked.where("comp <> q").select("p").distinct(), "p", "left_semi"), "split")

    more = by_region(split_regions(links), 1).mapInArrow(_later_pairs(percent, NEXT_PAIRS), pairs)
    links = links.unionByName(verified(written(more.select("a", "b").distinct(), "more"), rows, words, percent))
    doubtful = in_doubt(split_regions(links), small, percent, region_rows, block)
    links = links.unionByName(links_in_blocks(doubtful, rows, words, percent))
    return sets.select("doc_id", "n"), links.unionByName(copies)


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id that links reach) of every row."""
    sets, edges = jaccard_links(docs, words, percent)
    found = written(components(edges), "components")
    return sets.join(found, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for every document."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
