"""Prefix trie of conversations by fixed-length block hashing.

A conversation is cut into blocks of ``BLOCK`` turns. The digest of a prefix is the exclusive or of the 128-bit digests of
its turns, each mixed with its place, so that prefixes at block ends come from a scan over blocks instead of turns, and
the scan has two levels: no conversation has to fit into one task. Conversations are grouped by the digests at both ends
of each block first, which makes one row of all copies of a block behind equal prefixes. Only where siblings diverge
behind a prefix, the turns of their (distinct) blocks are grouped too; elsewhere a block's turns are a chain whose
members are those of the block.

Subtree figures need no walk over depths. Every node belongs to the chain of its smallest member; a chain is a stretch of
that member's path. Sums over a subtree are sums over its members of what each has alone: its text in all, less the part
of its path that is its own chain.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from crestline.operators.ranged import Ranged, running

from .storage import written

#: Turns per block.
BLOCK = 4
#: Ids joined into one row before the digest of a node's ends is taken.
IDS = 4096
KEY = ["depth", "x1", "x2"]


def _kept(rows: DataFrame) -> DataFrame:
    return written(rows, "trie-ranged", "lz4")


def ordered_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, pos, mark, bytes): turns numbered from 1, with a digest of role and text and the text's UTF-8 length.

    Null turns come first; turns with equal numbers follow in order of their digests. Null role or text is empty. Rows
    without a conversation id are left out. Texts do not move: only digests are dealt and sorted.
    """
    put = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    mark = F.unhex(F.md5(F.concat(F.octet_length(put(role)).cast("string"), F.lit(":"), put(role), put(text)).cast("binary")))
    light = df.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("c"), F.col(turn).alias("turn"), mark.alias("mark"), F.octet_length(put(text)).cast("long").alias("bytes"))
    order = ["turn", "mark"]
    # equal rows are interchangeable, so any numbering of them is the same one
    dealt = Ranged(light, ["c"], order, keep=_kept)
    rows = dealt.rows.withColumn("_n", F.row_number().over(dealt.window()).cast("long"))
    rows = dealt.carry([F.count(F.lit(1)).alias("_rows")], [F.sum("_rows").over(dealt.before()).alias("_up")], rows)
    return rows.select("c", (F.col("_n") + F.coalesce("_up", F.lit(0))).alias("pos"), "mark", "bytes")


def grafted(turns: DataFrame, group: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Every conversation c behind the first h turns of the one that its group of ``group`` ids begins with.

    h is the CRC-32 of the decimal id modulo ``heads``; the own turns after the first h follow. Returns the new turns
    (c, pos, mark, bytes) and all ids (c), those without turns too.
    """
    sizes = written(turns.groupBy("c").agg(F.max("pos").alias("len")), "trie-sizes")
    head = F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(heads))
    plan = sizes.select("c", (F.col("c") - F.col("c") % group).alias("s"), head.alias("h"))
    bases = sizes.select(F.col("c").alias("s"), F.col("len").alias("s_len"))
    # own turns move to the left where the other conversation is shorter than h
    shift = plan.join(bases, "s", "left").select("c", (F.col("h") - F.least("h", F.coalesce("s_len", F.lit(0)))).alias("shift"))
    shift = shift.where("shift > 0")
    own = turns.where((F.col("c") % group == 0) | (F.col("pos") > head))
    own = own.join(shift, "c", "left").withColumn(
        "pos", F.col("pos") - F.when(F.col("c") % group == 0, F.lit(0)).otherwise(F.coalesce("shift", F.lit(0)))).select("c", "pos", "mark", "bytes")
    first = turns.where((F.col("c") % group == 0) & (F.col("pos") < heads)).withColumnRenamed("c", "s")
    lent = first.join(plan.where("c <> s"), "s").where("pos <= h").select("c", "pos", "mark", "bytes")
    return written(own.unionByName(lent), "trie-turns", "lz4"), sizes.select("c")


def blocks(turns: DataFrame) -> DataFrame:
    """(c, k, n, turns, p1, p2, pre, q1, q2): block k of c, the digests before and behind it, and the text before it."""
    z1, z2 = F.xxhash64(F.lit(1), "pos", "mark"), F.xxhash64(F.lit(2), "mark", "pos")
    parts = turns.withColumns({"z1": z1, "z2": z2, "k": F.floor((F.col("pos") - 1) / BLOCK)})
    packed = parts.groupBy("c", "k").agg(
        F.sort_array(F.collect_list(F.struct("pos", "z1", "z2", "bytes"))).alias("turns"),
        F.bit_xor("z1").alias("b1"), F.bit_xor("z2").alias("b2"), F.sum("bytes").alias("size"), F.count(F.lit(1)).cast("int").alias("n"))
    chained = running(packed, ["c"], ["k"], {"p1": (F.bit_xor, F.col("b1")), "p2": (F.bit_xor, F.col("b2")), "pre": (F.sum, F.col("size"))},
                      keep=_kept)
    zero = F.lit(0).cast("long")
    out = chained.withColumns({c: F.coalesce(c, zero) for c in ("p1", "p2", "pre")})
    return written(out.select("c", "k", "n", "turns", "p1", "p2", "pre", F.col("p1").bitwiseXOR(F.col("b1")).alias("q1"),
                              F.col("p2").bitwiseXOR(F.col("b2")).alias("q2")), "trie-blocks", "lz4")


SPAN = ["k", "p1", "p2", "q1", "q2", "n"]


def _by_turn(groups: DataFrame, folds: dict[str, object]) -> DataFrame:
    """Groups of equal blocks as nodes, one per turn: a chain behind a prefix with one block, else grouped by turn."""
    def upto(count, start: str, field: str, step):
        return F.aggregate(F.slice("turns", F.lit(1), count), F.col(start), lambda a, t: step(a, t[field]))

    xor, add = (lambda a, b: a.bitwiseXOR(b)), (lambda a, b: a + b)
    each = F.explode(F.transform("turns", lambda t, i: F.struct(
        (F.col("k") * BLOCK + i + 1).alias("depth"), t["bytes"].alias("bytes"),
        upto(i + 1, "p1", "z1", xor).alias("x1"), upto(i + 1, "p2", "z2", xor).alias("x2"),
        upto(i, "p1", "z1", xor).alias("y1"), upto(i, "p2", "z2", xor).alias("y2"), upto(i, "pre", "bytes", add).alias("pre"))))
    rows = groups.select("solo", *folds, each).select("solo", *folds, "col.*")
    fixed = ["depth", "x1", "x2", "y1", "y2", "bytes", "pre"]
    merged = rows.where("NOT solo").groupBy(*fixed).agg(*[fold(F.col(n)).alias(n) for n, fold in folds.items()])
    return rows.where("solo").select(*fixed, *folds).unionByName(merged.select(*fixed, *folds))


def _ends(members: DataFrame) -> DataFrame:
    """SHA-256 of the ascending, comma-joined ids (c) of each node (KEY).

    Ids are joined in parallel, by ranges of (node, id), into rows of at most ``IDS``; the digest then runs over these in
    order and keeps nothing but its state.
    """
    kind = members.schema["c"].dataType
    schema = T.StructType([*[members.schema[k] for k in KEY], T.StructField("first", kind), T.StructField("ids", T.StringType())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch[k].to_numpy() for k in KEY]
            ids = batch["c"].to_numpy(zero_copy_only=False)
            new = np.zeros(batch.num_rows, bool)
            new[0] = True
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            at = np.flatnonzero(new)
            starts = np.sort(np.concatenate([at, *[np.arange(a + IDS, b, IDS) for a, b in zip(at, np.append(at[1:], len(new))) if b - a > IDS]])).astype(np.int64)
            stops = np.append(starts[1:], len(new))
            text = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(starts.tolist(), stops.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(k[starts]) for k in keys] + [pa.array(ids[starts]), pa.array(text, pa.string())],
                                             names=[*KEY, "first", "ids"])

    out = T.StructType([*[members.schema[k] for k in KEY], T.StructField("ends_sha256", T.StringType())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for *key, ids in zip(*[batch[k].to_pylist() for k in KEY], batch["ids"].to_pylist()):
                if key == now:
                    state.update(b",")
                else:
                    if now is not None:
                        done.append((*now, state.hexdigest()))
                    now, state = key, hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*done)], names=[*KEY, "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*now, state.hexdigest())], names=[*KEY, "ends_sha256"])

    lines = members.repartitionByRange(*KEY, "c").sortWithinPartitions(*KEY, "c").mapInArrow(join, schema)
    return lines.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digest, out)


def trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of numbered ``turns`` (c, pos, mark, bytes) of the conversations ``ids`` (c).

    One row per distinct sequence of first turns: conv_id (smallest member), depth, parent_conv_id (null for the root),
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256; for their meaning see :func:`conversation_trie`.
    No conversations give no nodes. ids are integers and unique.
    """
    zero = F.lit(0).cast("long")
    parts = blocks(turns)
    whole = turns.groupBy("c").agg(F.max("pos").alias("depth"), F.sum("bytes").alias("total"),
                                   F.bit_xor(F.xxhash64(F.lit(1), "pos", "mark")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(2), "mark", "pos")).alias("x2"))
    whole = ids.join(whole, "c", "left").select("c", *[F.coalesce(n, zero).alias(n) for n in ("depth", "x1", "x2", "total")])
    whole = written(whole, "trie-conversations")

    # copies of a block behind equal prefixes become one row; prefixes with one block need no look at its turns
    same = written(parts.groupBy(*SPAN).agg(F.count(F.lit(1)).alias("n_convs"), F.min("c").alias("conv_id"), F.first("turns").alias("turns"),
                                            F.first("pre").alias("pre")), "trie-spans", "lz4")
    split = same.groupBy("k", "p1", "p2").agg(F.count(F.lit(1)).alias("_siblings")).where("_siblings > 1")
    groups = written(same.join(split, ["k", "p1", "p2"], "left").withColumn("solo", F.col("_siblings").isNull()).drop("_siblings"), "trie-groups", "lz4")
    nodes = _by_turn(groups, {"n_convs": F.sum, "conv_id": F.min})
    root = whole.agg(F.count(F.lit(1)).alias("n_convs"), F.min("c").alias("conv_id")).where("n_convs > 0")
    root = root.select(*[zero.alias(n) for n in ("depth", "x1", "x2", "y1", "y2", "bytes", "pre")], "n_convs", "conv_id")
    nodes = nodes.unionByName(root)

    # children meet their parent in an aggregate, so that a parent of very many is combined before it moves
    none = lambda kind: F.lit(None).cast(kind)
    facts = ["y1", "y2", "bytes", "pre", "n_convs", "conv_id"]
    kids = nodes.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("y1").alias("x1"), F.col("y2").alias("x2"),
                                           *[none(nodes.schema[c].dataType).alias(c) for c in facts], F.lit(1).alias("kid"))
    nodes = nodes.withColumn("kid", F.lit(0)).unionByName(kids).groupBy(*KEY).agg(
        *[F.max(c).alias(c) for c in facts], F.sum("kid").alias("n_children"))
    nodes = written(nodes, "trie-nodes", "lz4")

    # what each conversation has beside its own chain, and whether it is the smallest one that ends at a leaf
    chain = nodes.groupBy(F.col("conv_id").alias("c")).agg(F.sum("bytes").alias("own"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaf"))
    each = written(whole.join(chain, "c", "left").select("c", (F.col("total") - F.coalesce("own", zero)).alias("rest"), F.coalesce("leaf", zero).alias("leaf")),
                   "trie-chains")
    folds = {"rest": F.sum, "leaf": F.sum, "top": F.min}
    sums = parts.drop("turns", "pre").join(each, "c").groupBy(*SPAN).agg(
        F.sum("rest").alias("rest"), F.sum("leaf").alias("leaf"), F.min(F.struct("c", "rest")).alias("top"))
    below = _by_turn(groups.join(sums, SPAN), folds)
    under = each.agg(F.sum("rest").alias("rest"), F.sum("leaf").alias("leaf"), F.min(F.struct("c", "rest")).alias("top")).where("top IS NOT NULL")
    below = below.select(*KEY, *folds).unionByName(under.select(*[zero.alias(k) for k in KEY], *folds))

    # all that is known of a node meets once more
    ends = _ends(whole.select(*KEY, "c"))
    columns = {**{c: nodes.schema[c].dataType for c in ("y1", "y2", "pre", "n_convs", "conv_id", "n_children")},
               **{c: below.schema[c].dataType for c in folds}, "ends_sha256": T.StringType()}
    sides = [side.select(*KEY, *[F.col(c) if c in side.columns else none(kind).alias(c) for c, kind in columns.items()])
             for side in (nodes.drop("bytes"), below, ends)]
    full = sides[0].unionByName(sides[1]).unionByName(sides[2]).groupBy(*KEY).agg(*[F.max(c).alias(c) for c in columns])
    saved = F.col("rest") - F.col("top.rest") - (F.col("n_convs") - 1) * F.col("pre")
    full = written(full.withColumn("saved_tokens", saved), "trie-full", "lz4")
    parents = full.select((F.col("depth") + 1).alias("depth"), F.col("x1").alias("y1"), F.col("x2").alias("y2"), F.col("conv_id").alias("parent_conv_id"))
    named = full.join(parents, ["depth", "y1", "y2"], "left")
    return named.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaf").alias("n_leaves"), "saved_tokens",
                        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """Trie of the conversations' turns (role, text) as they stand, without grafting.

    conversations has conv_id (integer), turn, role and text; other columns are ignored, whatever their names. n_convs
    counts the conversations that begin with a node's turns, n_children the nodes one turn longer, n_leaves the childless
    nodes in its subtree (itself included); saved_tokens sums over the subtree each node's (n_convs - 1) times the UTF-8
    bytes of its last text; ends_sha256 digests the ids that end here. See :func:`ordered_turns` for nulls and ties.
    """
    turns = written(ordered_turns(conversations), "trie-turns", "lz4")
    return trie(turns, turns.select("c").distinct())
