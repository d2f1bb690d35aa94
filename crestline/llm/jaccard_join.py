"""Exact n-gram Jaccard join in the metric space of shingle sets.

Jaccard distance d is a metric. Two kinds of pivots cut the space into regions:

1. Sets of one shingle. A document of n shingles has distance 1 - 1/n from the pivots of its own shingles and 1 from all
   others, so it is in the region of each of its shingles; ties go by one global order, rare shingles first. Linked
   documents miss at most floor((1 - t) n) of each other's shingles, hence their first common one is among the first
   floor((1 - t) n) + 1 of both: that window is where a document is replicated to, and two linked documents meet in the
   region of their first common shingle.
2. Documents. Each region has a pivot p, and d(x, p) is computed for all its members. Members within the limit of p are
   linked through it and need no comparison among each other. Of the others, x and y can only be linked if
   |d(x, p) - d(y, p)| is within the limit.

A third distance needs no text: each document has MARKS bits, those its shingles' hashes fall on. A bit that only x has
stands for a shingle that only x has, so x and y share at most n(x) less the bits that only x has. Pairs that cannot link
by this bound are never compared. Documents of more than LARGE shingles would set nearly all of them; they have at least
two bits a shingle besides, folded to the shorter one's length when two are held against each other. This sifts pairs
before any text moves. What it rules out keeps a lower bound of the distance, which the windows use like a distance.

Regions that still hold several components join again, recursively: each round draws PIVOTS times more of their members
as pivots and compares these with the members of other components inside the window, until a region is one component or
all its members have been pivots. A region of near copies ends after one or two rounds, linear in its members; only
members that stay apart, but within the windows of size, position and distance, are compared pair by pair. Regions with
the same members are one, and a pair that has met in an earlier region does not meet again, so that what the rounds join
follows the pairs and not the shingles that they share.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from .arrow import lists_of, slices, texts
from .components import connected_components
from .shingles import mixed, shingle_sets
from .storage import written

#: Shingles counted together inside a task, and documents among them from which on a shingle counts as common there.
BLOCK_SHINGLES, LOCALLY_COMMON = 3_000_000, 4
#: Common shingles that are sent to all tasks, a fixed number. They only decide the order, never which rows take part.
COMMON = 100_000
#: Members of a region of a common shingle that get a pivot of their own.
SALTED = 8_192
#: Times more pivots in each further round over the regions that still hold several components.
PIVOTS = 32
#: Regions of a member before each of its regions that are looked at for an earlier meeting.
EARLIER = 4
#: Rows of two numbers up to which a table is broadcast; larger ones are joined by a shuffle, with the same result.
BROADCAST_ROWS = 1_000_000


PROFILE = ["kind", "id", "n", "digest", "mark", "bits"]
#: Shingles from which on a document has bits besides its mark.
LARGE = 256


def _need(n: int, percent: int) -> int:
    """Least overlap of a linked document with one of n shingles."""
    return -(-percent * n // 100)


def _mark(own: np.ndarray) -> np.ndarray:
    """MARKS bits as long numbers: those that the leading bits of the hashes name."""
    bits = np.zeros(MARKS, np.uint8)
    bits[own >> np.uint64(65 - MARKS.bit_length())] = 1
    return np.packbits(bits).view(np.int64)


def _bits(own: np.ndarray) -> bytes | None:
    """Bits that the leading bits of the hashes name, two to four for each shingle; None if the mark says as much."""
    if len(own) <= LARGE:
        return None
    power = (2 * len(own) - 1).bit_length()
    bits = np.zeros(max(8, 1 << power), np.uint8)
    bits[own >> np.uint64(64 - max(3, power))] = 1
    return np.packbits(bits).tobytes()


def _most(x: bytes, y: bytes, nx: int, ny: int) -> int:
    """Most shingles that two documents with these bits can share."""
    short = min(len(x), len(y))
    one, other = (np.unpackbits(np.frombuffer(v, np.uint8)).reshape(8 * short, -1).any(1) for v in (x, y))
    both = int(np.count_nonzero(one & other))
    return min(nx - int(np.count_nonzero(one)) + both, ny - int(np.count_nonzero(other)) + both)


def _may_link(n: list, marks: list, percent: int) -> Column:
    """Whether two documents of these sizes and marks can share enough; documents without a mark can."""
    own = [reduce(lambda x, y: x + y, [F.bit_count(marks[i][k].bitwiseAND(F.bitwise_not(marks[1 - i][k]))) for k in range(MARKS // 64)]) for i in (0, 1)]
    most = F.least(n[0] - own[0], n[1] - own[1])
    return F.coalesce(most >= (n[0] + n[1]) * (percent / (100 + percent)) - 1e-6, F.lit(True))


def _profile(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One pass over all texts, written: a row (0, key, shingles, digest of the set, mark, bits) per document, and
    rows (1, shingle, documents, null, null, null) of the shingles that are common inside a block of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def common() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= LOCALLY_COMMON
            n = int(often.sum())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.array(values[often].view(np.int64)), pa.array(counts[often].astype(np.int64)),
                                               pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.binary())], names=PROFILE)

        for batch in batches:
            for part in slices(batch, text):
                sets = shingle_sets(texts(part, text))
                marks = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                for s, mark in zip(sets, marks):
                    if mark and mark not in seen:
                        seen.add(mark)
                        held.append(s)
                        size += len(s)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(sets), np.int32)), part[key].cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                                                  pa.array(marks, pa.binary()), lists_of(np.concatenate([_mark(s) for s in sets]), np.full(len(sets), MARKS // 64)),
                                                  pa.array([_bits(s) for s in sets], pa.binary())], names=PROFILE)
                if size >= BLOCK_SHINGLES:
                    yield common()
                    held, size, seen = [], 0, set()
        if held:
            yield common()

    return written(docs.select(key, text).mapInArrow(run, "kind int, id long, n long, digest binary, mark array<long>, bits binary"), "shingle-profile")


def _common(profile: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles, sorted, and their counts."""
    counted = profile.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "id").limit(COMMON).toArrow()
    values, counts = top["id"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(values)
    return values[order], counts[order]


def _ordered(own: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of a document in global order, rare ones first, and their counts (0: not common)."""
    values, counts = common
    at = np.minimum(np.searchsorted(values, own), max(len(values) - 1, 0))
    times = np.where(values[at] == own, counts[at], 0) if len(values) else np.zeros(len(own), np.int64)
    order = np.lexsort((own, times))
    return own[order], times[order]


#: Bits of a document's mark.
MARKS = 512
ROWS = "s long, x long, place long"


def _rows(s: np.ndarray, times: np.ndarray, x: np.ndarray, left: np.ndarray) -> pa.RecordBatch:
    """Window rows; place holds the number of shingles after this one above 16 bits of salt (0: region in one piece)."""
    parts = np.minimum(times // SALTED, 65_535).astype(np.uint64)
    salt = np.where(parts > 0, mixed(x.astype(np.int64).view(np.uint64), parts) % np.maximum(parts, np.uint64(1)) + np.uint64(1), np.uint64(0)).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(x.astype(np.int64)), pa.array((left.astype(np.int64) << 16) + np.minimum(salt, 65_535))], names=["s", "x", "place"])


def _first_level(docs: DataFrame, key: str, text: str, percent: int, sent) -> DataFrame:
    """Window rows of all documents; of copies inside a task only the first has any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in slices(batch, text):
                got = []
                for x, own in zip(part[key].to_pylist(), shingle_sets(texts(part, text))):
                    if x is None or not len(own):
                        continue
                    mark = xxhash.xxh3_128_digest(own.tobytes())
                    if mark in seen:
                        continue
                    if len(seen) < 200_000:  # only saves rows; without it copies meet in their regions
                        seen.add(mark)
                    s, times = _ordered(own, sent.value)
                    size = len(own) - _need(len(own), percent) + 1
                    got.append((s[:size], times[:size], x, len(own)))
                if got:
                    sizes = [len(g[0]) for g in got]
                    yield _rows(np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got]), np.repeat([g[2] for g in got], sizes),
                                np.concatenate([g[3] - 1 - np.arange(k) for g, k in zip(got, sizes)]))

    return docs.select(key, text).mapInArrow(run, ROWS)


def _regions(rows: DataFrame) -> DataFrame:
    """Members of regions with two at least, each with its region's pivot, the member with the smallest key. Streams over
    sorted rows; a region of a common shingle is spread by salt and keeps all its members, with a pivot for each salt."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pivot, head, pending = None, 0, 0, None  # key, pivot and its place of the open region, and its first row if not given out yet
        for batch in batches:
            if not batch.num_rows:
                continue
            s, salt, x, place = (batch[c].to_numpy() for c in ("s", "salt", "x", "place"))
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (salt[1:] != salt[:-1])
            new[0] = (s[0], salt[0]) != last
            starts = np.flatnonzero(new)
            run_of = np.cumsum(new)  # 0: the region that the batch before left open
            pivots, heads = np.concatenate([[pivot], x[starts]]), np.concatenate([[head], place[starts]])
            sizes = np.bincount(run_of, minlength=len(starts) + 1)
            keep = (salt > 0) | (sizes[run_of] > 1) | (run_of == 0)
            out = [[a[keep]] for a in (s, x, place, pivots[run_of], heads[run_of] >> 16)]
            if pending is not None and sizes[0]:
                for column, value in zip(out, pending):
                    column.insert(0, np.array([value]))
            pending = None
            last, pivot, head = (s[-1], salt[-1]), pivots[run_of[-1]], heads[run_of[-1]]
            if len(starts) and sizes[-1] == 1 and salt[-1] == 0:
                pending = (s[-1], x[-1], place[-1], x[-1], place[-1] >> 16)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=["s", "x", "place", "pivot", "pivot_left"])

    ordered = rows.withColumn("salt", F.col("place").bitwiseAND(65_535)).repartition("s", "salt").sortWithinPartitions("s", "salt", "x")
    return ordered.mapInArrow(run, "s long, x long, place long, pivot long, pivot_left long")


def _sized(table: DataFrame) -> DataFrame:
    """The table, broadcast if it is proven to be small."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def _packed(rows: DataFrame) -> DataFrame:
    """(id, text) with compressed texts, which move to their pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [zlib.compress((t or "").encode(), 3) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(packed, pa.binary())], names=["id", "text"])

    return rows.mapInArrow(run, "id long, text binary")


def _sifted(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with stays, false if their bits prove that they cannot link, and then a lower bound of the distance."""
    left = bits.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bits").alias("left"))
    right = bits.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("right"))
    both = pairs.select("a", "b").join(left, "a", "left").join(right, "b", "left").select("a", "b", "na", "nb", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays, least = np.ones(batch.num_rows, bool), np.zeros(batch.num_rows)
            for i in np.flatnonzero((batch["left"].is_valid().to_numpy(zero_copy_only=False)) & (batch["right"].is_valid().to_numpy(zero_copy_only=False))).tolist():
                x, y, nx, ny = (batch[c][i].as_py() for c in ("left", "right", "na", "nb"))
                most = _most(x, y, nx, ny)
                if most * (100 + percent) < percent * (nx + ny):
                    stays[i], least[i] = False, 1 - most / (nx + ny - most)
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(stays), pa.array(least)], names=["a", "b", "stays", "least"])

    return both.mapInArrow(run, "a long, b long, stays boolean, least double")


def _compared(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Sizes and intersections of pairs (a, b); of the documents (id, text) only those in pairs are kept and moved."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    stored = written(_packed(docs.join(_sized(ids), "id", "left_semi")), "pair-texts")
    left = stored.select(F.col("id").alias("a"), F.col("text").alias("left"))
    right = stored.select(F.col("id").alias("b"), F.col("text").alias("right"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}  # sets of the last 128 pairs; the join leaves pairs of one b together
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                left, right = part["left"].to_pylist(), part["right"].to_pylist()
                texts = dict.fromkeys([*left, *right])
                new = [p for p in texts if p not in known]
                for k in range(0, len(new), 64):
                    known.update(zip(new[k:k + 64], shingle_sets(pa.array([zlib.decompress(p).decode() for p in new[k:k + 64]], pa.string()))))
                known = {p: known[p] for p in texts}
                same = [len(np.intersect1d(known[p], known[q], assume_unique=True)) for p, q in zip(left, right)]
                union = [len(known[p]) + len(known[q]) - n for p, q, n in zip(left, right, same)]
                yield pa.RecordBatch.from_arrays([part["a"], part["b"], pa.array(same, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "same", "all"])

    return both.mapInArrow(run, "a long, b long, same long, all long")


def _pairs(frame: DataFrame, a: str, b: str) -> DataFrame:
    return frame.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _merged(found: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of regions with several components, one region for all those with the same members, each with the EARLIER
    regions that its member is in before.

    Near copies share a region for every shingle of their windows; without this they would meet in each of them. A merged
    region is named by a hash of its members, which are taken together however many regions they come from, and a member
    keeps the most shingles that it has left in any of them: all pairs of each region are pairs of the merged one, and no
    bound gets tighter. Regions whose hashes collide are one larger region, with more to compare and the same links.

    Two members that share one of their earlier regions meet there, or in a region before that, where both have at least as
    many shingles left: every pair still meets where it shares none of them.
    """
    held = found.join(_sized(known.select(F.col("id").alias("x"), F.col("component").alias("c"))), "x")
    several = held.groupBy("s").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min("x").alias("first"), F.max("x").alias("last"),
                                    F.count("*").alias("size"), F.sum(F.shiftrightunsigned(F.xxhash64("x"), 31)).alias("hashes"))
    several = several.where(F.col("low") < F.col("high")).select("s", F.xxhash64("first", "last", "size", "hashes").alias("region"))
    rows = found.join(several, "s").groupBy(F.col("region").alias("s"), "x").agg(F.max("place").alias("place"), F.min("pivot").alias("pivot"))
    before = Window.partitionBy("x").orderBy(F.shiftright("place", 16).desc(), "s").rowsBetween(-EARLIER, -1)
    return rows.withColumn("earlier", F.collect_list("s").over(before))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """Per row of ``docs``: key, n_shingles and component_id, the smallest key that links reach.

    Documents link when 100 * intersection >= percent * union of their sets of 5-word shingles, compared exactly (as
    64-bit hashes). Texts without words (null, empty, white space) have no shingle and link with nothing. Equal sets are
    one class with its smallest key as representative. Rows with the same key are one document for links, each with its
    own n_shingles; a null key takes no part and has a null component. Other columns are not looked at.
    """
    profile = _profile(docs, key, text)
    own = profile.where("kind = 0").select("id", "n", "digest")
    classes = own.where("digest IS NOT NULL AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("rep"))
    rows = own.join(classes, "digest", "left").select("id", "n", F.coalesce("rep", "id").alias("rep"))
    members = written(rows, "shingle-classes")
    sent = docs.sparkSession.sparkContext.broadcast(_common(profile))  # at most COMMON rows
    limit = 1 - percent / 100 + 1e-9

    found = written(_regions(_first_level(docs, key, text, percent, sent)), "regions")
    involved = written(found.select(F.col("x").alias("id")).distinct(), "region-members")
    whole_texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    sizes = members.where("id IS NOT NULL").groupBy("id").agg(F.min("rep").alias("rep"), F.min("n").alias("n"))
    # a key with several texts has no mark
    marks = profile.where("kind = 0").join(_sized(involved), "id", "left_semi").groupBy("id").agg(F.when(F.min("digest") == F.max("digest"), F.min("mark")).alias("mark"))
    reps = written(sizes.join(marks, "id"), "region-classes")
    whole = reps.where(F.col("mark").isNotNull() & (F.col("n") > LARGE)).select("id", "n")
    bits = written(profile.where("kind = 0 AND bits IS NOT NULL").select("id", "bits").join(_sized(whole), "id").dropDuplicates(["id"]), "region-bits")
    # members with their pivots, and the pivots of one salted region with each other; equal classes need no comparison.
    # A pair that cannot link here by what both have left is not compared: if it links, it meets in an earlier region
    # again, where the rounds below find it.
    shared = 1 + F.least(F.shiftright("place", 16), F.col("pivot_left"))
    stars = found.where("x <> pivot").groupBy("x", "pivot").agg(F.max(shared).alias("shared"))
    heads = found.where(F.col("place").bitwiseAND(65_535) > 0).select("s", "pivot").distinct()
    heads = heads.join(heads.groupBy("s").agg(F.min("pivot").alias("x")), "s").where("x <> pivot").select("x", "pivot", F.lit(1 << 40).alias("shared")).distinct()
    ends = [reps.select(F.col("id").alias(c), F.col("rep").alias(f"r{c}"), F.col("n").alias(f"n{c}"), F.col("mark").alias(f"m{c}")) for c in ("x", "pivot")]
    both = stars.unionByName(heads).join(_sized(ends[0]), "x").join(_sized(ends[1]), "pivot").where("rx <> rpivot").where(
        _may_link([F.col("nx"), F.col("npivot")], [F.col("mx"), F.col("mpivot")], percent))
    pairs = _pairs(both.where((F.least("nx", "npivot") * 100 >= F.greatest("nx", "npivot") * percent) & (F.col("shared") >= (F.col("nx") + F.col("npivot")) * (percent / (100 + percent)) - 1e-6)), "x", "pivot")
    sifted = written(_sifted(pairs, bits, percent), "sifted")
    distances = written(_compared(sifted.where("stays"), whole_texts), "distances")
    d = 1 - F.col("same") / F.col("all")
    far = distances.select("a", "b", d.alias("low"), d.alias("high")).unionByName(sifted.where("NOT stays").select("a", "b", F.col("least").alias("low"), F.lit(1.0).alias("high")))
    from_pivot = far.unionByName(far.select(F.col("b").alias("a"), F.col("a").alias("b"), "low", "high")).withColumnsRenamed({"a": "x", "b": "pivot"})
    copies = reps.select(F.col("id").alias("a"), F.col("rep").alias("b"))
    tested, pivots = sifted.select("a", "b"), 1
    known = written(connected_components(copies.unionByName(_linked(distances, percent))), "components")
    open_rows = written(_merged(found, known), "merged-regions")
    while True:
        # what is left: regions with several components, of which fewer than all members have been pivots
        held = open_rows.drop("c", "size").join(_sized(known.select(F.col("id").alias("x"), F.col("component").alias("c"))), "x")
        left = held.groupBy("s").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("size")).where(F.col("low") < F.col("high"))
        left = left.where(F.col("size") > (pivots if pivots > 1 else 0)).select("s", "size")
        open_rows = held.join(left, "s")
        if pivots == 1:
            open_rows = open_rows.join(reps.select(F.col("id").alias("x"), "n", "mark"), "x").join(from_pivot, ["x", "pivot"], "left")
        open_rows = written(open_rows, "open-regions")
        if open_rows.isEmpty():
            break
        pivots *= PIVOTS
        rest = open_rows.withColumn("left", F.shiftright("place", 16))
        chosen = F.pmod(F.xxhash64("q.x"), F.lit(1 << 30)) < F.lit(1 << 30) * (F.lit(pivots) / F.col("q.size"))
        meet = rest.alias("p").join(rest.alias("q").where((F.col("q.size") <= pivots) | chosen), F.col("p.s") == F.col("q.s")).where(
            (F.col("p.x") != F.col("q.x")) & (F.col("p.c") != F.col("q.c")) & ~F.arrays_overlap("p.earlier", "q.earlier") & ((F.col("p.size") > pivots) | (F.col("p.x") < F.col("q.x")))
            & (F.least("p.n", "q.n") * 100 >= F.greatest("p.n", "q.n") * percent)
            # what they can share from here on, against the least overlap of a link of these sizes
            & (1 + F.least("p.left", "q.left") >= (F.col("p.n") + F.col("q.n")) * (percent / (100 + percent)) - 1e-6)
            & ((F.col("p.pivot") != F.col("q.pivot")) | F.coalesce(F.greatest(F.col("p.low") - F.col("q.high"), F.col("q.low") - F.col("p.high")) <= limit, F.lit(True)))
            & _may_link([F.col("p.n"), F.col("q.n")], [F.col("p.mark"), F.col("q.mark")], percent))
        pairs = _pairs(meet.select(F.col("p.x").alias("x"), F.col("q.x").alias("y")), "x", "y").join(tested, ["a", "b"], "left_anti")
        sifted = written(_sifted(pairs, bits, percent), "sifted")
        distances = written(_compared(sifted.where("stays"), whole_texts), "distances")
        tested, more = tested.unionByName(sifted.select("a", "b")), _linked(distances, percent)
        if not more.isEmpty():
            known = written(_united(known, more), "components")
    joined = members.join(known, members.id == known.id, "left").select(members.id.alias("id"), "n", "rep", "component")
    # copies whose class stands in the regions under another member take that one's component
    of_class = joined.where("component IS NOT NULL").groupBy("rep").agg(F.min("component").alias("own"))
    return joined.join(of_class, "rep", "left").select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("own", "rep").alias("component_id"))


def _united(known: DataFrame, links: DataFrame) -> DataFrame:
    """Components (id, component) after more links: only the components that these touch are looked at, as single nodes."""
    between = links.join(known.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a").join(known.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b")
    lower = connected_components(between.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()).select(F.col("id").alias("component"), F.col("component").alias("lower"))
    return known.join(lower, "component", "left").select("id", F.coalesce("lower", "component").alias("component"))


def _linked(distances: DataFrame, percent: int) -> DataFrame:
    return distances.where(F.col("same") * 100 >= F.col("all") * percent).select("a", "b")


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """The document with the smallest key of every component; of repeated rows with that key, one.

    Rows without a key are no part of any group and stay.
    """
    found = jaccard_components(docs, key, text, percent)
    stay = found.where(F.col(key) == F.col("component_id")).select(key).distinct()
    kept = docs.join(stay, key, "left_semi")
    twice = found.groupBy(key).agg(F.count("*").alias("rows")).where(F.col("rows") > 1).select(key)
    ranked = Window.partitionBy(key).orderBy(F.xxhash64(*docs.columns))
    single = kept.join(twice, key, "left_anti")
    repeated = kept.join(twice, key, "left_semi").withColumn("_rank", F.row_number().over(ranked)).where("_rank = 1").drop("_rank")
    return single.unionByName(repeated).unionByName(docs.where(F.col(key).isNull())).select(docs.columns)
