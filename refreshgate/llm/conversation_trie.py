"""Prefix trie of conversations: which openings they share, how they branch, and what training on shared turns once would save.

A turn counts as its digest and the size of its text; texts are never shuffled. Conversations are sorted by their digests.
Two neighbours share the path as deep as their longest common prefix (LCP). Union-find joins neighbours over these edges,
deepest first: two components meet in a branching node, and the chain of nodes above a component down to that node is
complete. Every task does so for blocks of sorted rows. A node that lies on the path of a block's first or last row may go
on in the next block: these few are contracted to one row per block and merged by their prefix, with one correction per
depth and boundary for what both sides have counted.

Long conversations are cut into bands of BAND turns, so no row, sort key or task holds a whole one. A band is sorted under
the digest of everything before it, like a trie of its own, and what a band adds to the nodes above it is passed up along
the conversation.
"""
import pickle
import struct
from collections.abc import Iterable, Iterator
from hashlib import blake2b, sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from refreshgate.llm.batches import map_batches
from refreshgate.session import cut_lineage

BAND = 64     # turns of a unit, the part of a conversation that is sorted as one row
BLOCK = 4096  # units joined at once
WIDE = 16     # bytes of a turn's digest
IDS_PER_CHUNK = 256
PIECE = "conv_id long, first long, keys binary, sizes binary"
DONE, SPINE, CORRECTION, ENDS, EDGE = range(5)
NODE = ("kind int, block long, ord int, parent_ord int, depth long, conv_id long, parent_conv_id long, n_convs long, "
        "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key binary, data binary")


class Unit(NamedTuple):
    """A band of a conversation. root1, root2 name all before the band, next1, next2 all up to its end."""
    band: int
    root1: int
    root2: int
    keys: bytes
    goes_on: bool
    conv_id: int
    sizes: bytes
    next1: int
    next2: int
    leaves: int  # of the bands after this one
    saved: int


UNIT_ORDER = ["band", "root1", "root2", "keys", "goes_on", "conv_id"]


# ---- turns to pieces of conversations

def turn_runs(conversations: DataFrame, width: int = BAND) -> DataFrame:
    """conv_id, first, keys, sizes: every conversation in order of `turn`, in runs of at most `width` turns from place `first`.

    NULL turns come first; equal turns stand by digest. The rows are sorted in ranges, so one long conversation is dealt
    over many tasks; a run's place is its place in its range and the number of turns in earlier ranges. Rows without a
    conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    digest = F.unhex(F.substring(F.sha2(named, 256), 1, 2 * WIDE))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"),
        F.octet_length(text).cast("long").alias("size"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, conv, at, keys, sizes = TaskContext.get().partitionId(), None, 0, b"", b""

        def made(out):
            return pa.RecordBatch.from_arrays(
                [pa.array([place] * len(out), pa.int32()), *(pa.array(c, t) for c, t in zip(
                    zip(*out) if out else [()] * 4, (pa.int64(), pa.int64(), pa.binary(), pa.binary())))],
                ["range", "conv_id", "first", "keys", "sizes"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids, out = batch.column("conv_id").to_numpy(), []
            raw, own = b"".join(batch.column("digest").to_pylist()), batch.column("size").to_numpy().astype("<i8").tobytes()
            edges = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
            for a, b in zip(edges, edges[1:]):
                if ids[a] != conv:
                    if keys:
                        out.append((conv, at, keys, sizes))
                    conv, at, keys, sizes = int(ids[a]), 0, b"", b""
                while a < b:
                    to = min(b, a + width - len(keys) // WIDE)
                    keys, sizes, a = keys + raw[WIDE * a:WIDE * to], sizes + own[8 * a:8 * to], to
                    if len(keys) == WIDE * width:
                        out.append((conv, at, keys, sizes))
                        at, keys, sizes = at + width, b"", b""
            yield made(out)
        if keys:
            yield made([(conv, at, keys, sizes)])

    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "size")
    runs = cut_lineage(map_batches(ranged, run, f"range int, {PIECE}"))
    # only the first and the last conversation of a range can go on in another: two ids per range
    outer = runs.groupBy("range").agg(F.array(F.min("conv_id"), F.max("conv_id")).alias("ids")).select(
        "range", F.explode(F.array_distinct("ids")).alias("conv_id")).groupBy("conv_id").agg(F.count("*").alias("n")).where("n > 1")
    per_range = runs.join(F.broadcast(outer.select("conv_id")), "conv_id", "left_semi").groupBy("conv_id", "range").agg(
        F.sum(_turns("keys")).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_range.select("conv_id", "range", F.sum("n").over(earlier).alias("carried"))
    return runs.join(F.broadcast(carried), ["conv_id", "range"], "left").select(
        "conv_id", (F.col("first") + F.coalesce("carried", F.lit(0))).alias("first"), "keys", "sizes")


def _turns(keys: str) -> Column:
    return F.expr(f"length({keys}) div {WIDE}")


def _joined(column: str) -> Column:
    """The pieces of a group one after the other; a group holds what fits into one band."""
    return F.expr(f"aggregate(pieces, cast('' as binary), (a, x) -> concat(a, x.{column}))").alias(column)


def _gathered(column: str = "first") -> Column:
    return F.array_sort(F.collect_list(F.struct(column, "keys", "sizes"))).alias("pieces")


def with_family_opening(runs: DataFrame, family: int = 5, openings: int = 9) -> DataFrame:
    """Pieces of rebuilt conversations: c begins with the first h turns of conversation c - c % family, then its own after its first h.

    h is the crc32 of the id in decimal, modulo `openings`. A shorter first conversation gives all its turns, an absent
    one none. Every conv_id stays, without turns if none are left.
    """
    longest = openings - 1
    heads = runs.where((F.col("conv_id") % family == 0) & (F.col("first") < longest)).groupBy("conv_id").agg(_gathered()).select(
        F.col("conv_id").alias("base"), _joined("keys"), _joined("sizes"))
    convs = runs.select("conv_id").distinct().select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % family).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % openings).alias("h"))
    begun = convs.join(heads, "base", "left").select(
        "conv_id", "h", F.lit(0).cast("long").alias("first"),
        F.expr(f"coalesce(substring(keys, 1, cast(h * {WIDE} as int)), cast('' as binary))").alias("keys"),
        F.expr("coalesce(substring(sizes, 1, cast(h * 8 as int)), cast('' as binary))").alias("sizes"))
    shift = begun.select("conv_id", "h", _turns("keys").alias("n_begun"))
    own = runs.withColumn("n", _turns("keys")).join(shift, "conv_id").where(F.col("first") + F.col("n") > F.col("h"))
    own = own.withColumn("skip", F.greatest(F.lit(0), F.col("h") - F.col("first")).cast("int"))
    own = own.select("conv_id", (F.col("n_begun") + F.col("first") + F.col("skip") - F.col("h")).alias("first"),
                     F.expr(f"substring(keys, skip * {WIDE} + 1)").alias("keys"), F.expr("substring(sizes, skip * 8 + 1)").alias("sizes"))
    return begun.select("conv_id", "first", "keys", "sizes").unionByName(own)


# ---- pieces to bands

def units(pieces: DataFrame, width: int = BAND) -> DataFrame:
    """The bands of conversations given in pieces, with the columns of UNIT_ORDER, sizes, next1, next2 and is_long.

    The name of what comes before a band combines two hashes of each earlier band and its number, along the conversation;
    that window sees one short row per band, and only of conversations of several bands.
    """
    pieces = cut_lineage(pieces)
    lengths = pieces.groupBy("conv_id").agg(F.max(F.col("first") + _turns("keys")).alias("n_turns"))
    end = F.col("first") + _turns("keys")
    bands = F.expr(f"sequence(first div {width}, greatest(first div {width}, (first + length(keys) div {WIDE} - 1) div {width}))")
    parts = pieces.select("conv_id", "first", "keys", "sizes", end.alias("end"), F.explode(bands).alias("band")).withColumns({
        "lo": F.greatest("first", F.col("band") * width), "hi": F.least("end", (F.col("band") + 1) * width)})

    def cut(column: str, wide: int) -> Column:
        return F.expr(f"substring({column}, cast({wide} * (lo - first) + 1 as int), cast({wide} * (hi - lo) as int))").alias(column)

    whole = parts.select("conv_id", "band", "lo", cut("keys", WIDE), cut("sizes", 8)).groupBy("conv_id", "band").agg(
        _gathered("lo")).select("conv_id", "band", _joined("keys"), _joined("sizes"))
    made = cut_lineage(whole.join(lengths, "conv_id").select(
        "conv_id", "band", "keys", "sizes", (F.col("n_turns") > (F.col("band") + 1) * width).alias("goes_on"),
        (F.col("n_turns") > width).alias("is_long"), F.xxhash64(F.lit(1), "band", "keys").alias("own1"),
        F.xxhash64(F.lit(2), "band", "keys").alias("own2")))
    before = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    root = {f"root{k}": F.coalesce(F.bit_xor(f"own{k}").over(before), F.lit(0).cast("long")) for k in (1, 2)}
    roots = made.where("is_long").select("conv_id", "band", *(c.alias(n) for n, c in root.items()))
    zero = F.lit(0).cast("long")
    named = made.where("is_long").join(roots, ["conv_id", "band"]).unionByName(
        made.where("NOT is_long").withColumns({"root1": zero, "root2": zero}))
    return named.withColumns({f"next{k}": F.col(f"root{k}").bitwiseXOR(F.col(f"own{k}")) for k in (1, 2)}).drop("own1", "own2")


# ---- sorted bands to nodes

def common(a: bytes, b: bytes) -> int:
    """Turns of the longest common prefix."""
    low, high = 0, min(len(a), len(b)) // WIDE
    while low < high:
        middle = (low + high + 1) // 2
        if a[:WIDE * middle] == b[:WIDE * middle]:
            low = middle
        else:
            high = middle - 1
    return low


def shared_depth(a: Unit, b: Unit) -> int:
    """Turns of their band that sorted neighbours share, -1 if something before the band differs."""
    return common(a.keys, b.keys) if a[:3] == b[:3] else -1


def byte_sums(own: Unit, depth: int) -> int:
    return int(np.frombuffer(own.sizes, "<i8", depth).sum()) if depth > 0 else 0


def ends_leaf(own: Unit, shared: int) -> bool:
    """Whether a unit, the last of its copies in order, ends at a node without children, given the depth shared with the next."""
    return not own.goes_on and shared < len(own.keys) // WIDE


def node_key(own: Unit, depth: int, width: int) -> bytes:
    """Names the node `depth` turns down a unit's path; the end of a full band is the beginning of the next."""
    if depth == width:
        return struct.pack("<qqqi", own.band + 1, own.next1, own.next2, 0)
    head = struct.pack("<qqqi", own.band, own.root1, own.root2, depth)
    return head + (blake2b(own.keys[:WIDE * depth], digest_size=WIDE).digest() if depth else b"")


def ids_hash(ids: Iterable[int]) -> str:
    return sha256(",".join(map(str, ids)).encode()).hexdigest()


NO_IDS = ids_hash(())


def forest(own: list[Unit], block: int, width: int) -> list[list]:
    """Rows of NODE for a block of sorted units: complete nodes, and the parts of those that may go on beyond the block."""
    n = len(own)
    shared = [-1, *(shared_depth(a, b) for a, b in zip(own, own[1:])), -1]
    sizes = [np.frombuffer(u.sizes, "<i8").tolist() for u in own]
    up, low, high, top = list(range(n)), list(range(n)), list(range(n)), [len(u.keys) // WIDE for u in own]
    conv, count, children = [u.conv_id for u in own], [1] * n, [0] * n
    leaves = [u.leaves + ends_leaf(u, s) for u, s in zip(own, shared[1:])]
    below, ends = [u.saved for u in own], [[] if u.goes_on else [u.conv_id] for u in own]
    waiting: list[list[list]] = [[] for _ in own]  # nodes whose parent is not complete yet
    rows: list[list] = []

    def find(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    def complete(k: int) -> None:
        """The node at the component's top; what is above it becomes the top."""
        depth, first = top[k], own[low[k]]
        if depth:
            below[k] += (count[k] - 1) * sizes[low[k]][depth - 1]
        on_spine = low[k] == 0 or high[k] == n - 1 or depth in (0, width)
        again = depth == 0 and first.band > 0  # known in full at the end of the band before
        row = [DONE, block, None, None, first.band * width + depth, *((None, None, 0, children[k], 0, 0) if again else (
            conv[k], None, count[k], children[k], leaves[k], below[k])), None, None, None]
        if on_spine:
            row[0], row[2], row[12] = SPINE, len(rows), node_key(first, depth, width)
        else:
            row[11] = ids_hash(ends[k]) if ends[k] else NO_IDS
        for child in waiting[k]:
            child[3 if on_spine else 6] = row[2] if on_spine else conv[k]
        rows.append(row)
        if on_spine and not again:
            for at in range(0, len(ends[k]), IDS_PER_CHUNK):
                text = ",".join(map(str, ends[k][at:at + IDS_PER_CHUNK])).encode()
                rows.append([ENDS, block, None, None, at, None, None, 0, 0, 0, 0, None, row[12], text])
        waiting[k], children[k], ends[k], top[k] = [row], 1, [], depth - 1

    for k in sorted((k for k in range(1, n) if shared[k] >= 0), key=lambda k: -shared[k]):
        a, b, depth = find(k - 1), find(k), shared[k]
        for side in (a, b):
            while top[side] > depth:
                complete(side)
        up[b], high[a] = a, high[b]
        conv[a] = min(conv[a], conv[b])
        for column in (count, children, leaves, below, ends, waiting):
            column[a] += column[b]
    for k in range(n):
        if up[k] == k:
            while top[k] >= 0:
                complete(k)
    return rows


def corrections(last: Unit, first: Unit, width: int) -> list[tuple]:
    """What two blocks have counted twice along the path that the last unit of one shares with the first of the next."""
    depth, rows, saved = shared_depth(last, first), [], 0
    twice = int(depth >= 0 and ends_leaf(last, -1) and not ends_leaf(last, depth))
    sizes = np.frombuffer(first.sizes, "<i8").tolist()
    for at in range(depth, -1, -1):
        if at:
            saved += sizes[at - 1]
        again = at == 0 and first.band > 0
        rows.append((CORRECTION, None, None, None, None, None, None, 0, -int(at < depth), *((0, 0) if again else (-twice, saved)),
                     None, node_key(first, at, width), None))
    return rows


def _node_batch(rows: list) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in NODE.split(", ")))
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types)], list(names))


def _units_of(batch: pa.RecordBatch) -> Iterator[Unit]:
    return map(Unit._make, zip(*(batch.column(c).to_pylist() for c in Unit._fields)))


def _edge(place: int, side: int, own: Unit) -> tuple:
    return (EDGE, place, side, *[None] * 4, 0, 0, 0, 0, None, None, pickle.dumps(tuple(own)))


def _block_rows(batches: Iterator[pa.RecordBatch], width: int, most: int) -> Iterator[pa.RecordBatch]:
    """NODE rows of a task's sorted units, `most` at once; its first and last unit go on as EDGE rows."""
    place, held, last, number = TaskContext.get().partitionId(), [], None, 0

    def block(some: list[Unit]) -> pa.RecordBatch:
        nonlocal last, number
        rows = [_edge(place, 0, some[0])] if last is None else corrections(last, some[0], width)
        rows += forest(some, (place << 32) + number, width)
        last, number = some[-1], number + 1
        return _node_batch(rows)

    for batch in batches:
        held += _units_of(batch)
        while len(held) >= most:
            yield block(held[:most])
            held = held[most:]
    if held:
        yield block(held)
    if last is not None:
        yield _node_batch([_edge(place, 1, last)])


def _across(rows: Iterator[tuple]) -> Iterator[tuple[Unit, Unit]]:
    """(last unit of a task, first unit of the next) from the EDGE rows of all tasks in order."""
    last = None
    for side, data in rows:
        own = Unit._make(pickle.loads(data))
        if side == 0 and last is not None:
            yield last, own
        last = own if side else last


def _edge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    for batch in batches:
        yield from zip(batch.column("ord").to_pylist(), batch.column("data").to_pylist())


def _in_order(edges: DataFrame) -> DataFrame:
    """The EDGE rows, two per task of the sort before, in one task that streams through them."""
    return edges.select("block", "ord", "data").repartition(1).sortWithinPartitions("block", "ord")


def _later_bands(made: DataFrame) -> DataFrame:
    """conv_id, band, leaves, saved: what the later bands of a conversation add to the nodes of each of its bands.

    A unit counts as a leaf if it ends at one and is the last of its copies in order, and saves the bytes that it shares
    with the unit before it; units of a task are compared in its stream, those beside each other in two tasks after it.
    """
    def row(own: Unit, leaf: int, saved: int) -> tuple:
        return DONE, None, None, None, own.band, own.conv_id, None, 0, 0, leaf, saved, None, None, None

    def run(batches):
        place, last, rows = TaskContext.get().partitionId(), None, []
        for batch in batches:
            for own in _units_of(batch):
                if last is None:
                    rows += [_edge(place, 0, own), row(own, 0, 0)]
                else:
                    depth = shared_depth(last, own)
                    rows += [row(last, int(ends_leaf(last, depth)), 0), row(own, 0, byte_sums(own, depth))]
                last = own
            yield _node_batch(rows)
            rows = []
        if last is not None:
            yield _node_batch([row(last, int(ends_leaf(last, -1)), 0), _edge(place, 1, last)])

    def bounds(batches):
        for last, first in _across(_edge_rows(batches)):
            depth = shared_depth(last, first)
            yield _node_batch([row(last, int(ends_leaf(last, depth)) - int(ends_leaf(last, -1)), 0), row(first, 0, byte_sums(first, depth))])

    several = made.where("is_long").withColumns({"leaves": F.lit(0).cast("long"), "saved": F.lit(0).cast("long")})
    later = several.where("band > 0").select(*Unit._fields)
    found = cut_lineage(map_batches(later.repartitionByRange(*UNIT_ORDER).sortWithinPartitions(*UNIT_ORDER), run, NODE))
    whole = found.where(F.col("kind") == DONE).unionByName(map_batches(_in_order(found.where(F.col("kind") == EDGE)), bounds, NODE))
    per_band = whole.groupBy("conv_id", F.col("depth").alias("band")).agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    after = Window.partitionBy("conv_id").orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    return several.select("conv_id", "band").join(per_band, ["conv_id", "band"], "left").select(
        "conv_id", "band", *(F.coalesce(F.sum(c).over(after), F.lit(0)).alias(c) for c in ("leaves", "saved")))


def _ends(chunks: DataFrame) -> DataFrame:
    """key, ends_sha256 of nodes whose ids come in chunks: SHA-256 takes its input in order, so a node's chunks are streamed
    through one hash state, one chunk in memory at a time."""
    def run(batches):
        key, state, first = None, None, True
        for batch in batches:
            out = []
            for own, data in zip(batch.column("key").to_pylist(), batch.column("data").to_pylist()):
                if own != key:
                    if state is not None:
                        out.append((key, state.hexdigest()))
                    key, state, first = own, sha256(), True
                state.update(data if first else b"," + data)
                first = False
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([h for _, h in out], pa.string())], ["key", "ends"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends"])

    ordered = chunks.select("key", "block", "depth", "data").repartition("key").sortWithinPartitions("key", "block", "depth")
    return map_batches(ordered, run, "key binary, ends string")


def nodes(pieces: DataFrame, width: int = BAND, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node of the trie.

    `pieces` (conv_id, first, keys, sizes) are parts of conversations that make them up without gaps or overlaps; a
    conversation without turns is one piece without keys. No pieces, no nodes.
    """
    made = cut_lineage(units(pieces, width))
    later = _later_bands(made)
    whole = made.join(later, ["conv_id", "band"], "left").withColumns(
        {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("leaves", "saved")}).select(*Unit._fields)

    def run(batches):
        yield from _block_rows(batches, width, block)

    def bounds(batches):
        for last, first in _across(_edge_rows(batches)):
            yield _node_batch(corrections(last, first, width))

    found = cut_lineage(map_batches(whole.repartitionByRange(*UNIT_ORDER).sortWithinPartitions(*UNIT_ORDER), run, NODE))

    spine, edges = found.where(F.col("kind").isin(SPINE, CORRECTION)), found.where(F.col("kind") == EDGE)
    parts = spine.unionByName(map_batches(_in_order(edges), bounds, NODE))
    counts = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    merged = cut_lineage(parts.groupBy("key").agg(
        F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("parent_conv_id").alias("known"), *(F.sum(c).alias(c) for c in counts)))
    # a child's parent is looked up by its block's own row, so a node of many children is as many keys as blocks
    here = cut_lineage(found.where(F.col("kind") == SPINE).select("block", "ord", "parent_ord", "key").join(
        merged.select("key", F.col("conv_id").alias("conv")), "key"))
    parent = here.select("block", F.col("ord").alias("parent_ord"), F.col("conv").alias("parent"))
    columns = ["conv_id", "depth", "parent_conv_id", *counts, "ends_sha256"]
    done = found.where(F.col("kind") == DONE).join(parent, ["block", "parent_ord"], "left").withColumn(
        "parent_conv_id", F.coalesce("parent_conv_id", "parent")).select(*columns)
    above = here.join(parent, ["block", "parent_ord"]).groupBy("key").agg(F.max("parent").alias("above"))
    ends = _ends(found.where(F.col("kind") == ENDS))
    inner = merged.join(above, "key", "left").join(ends, "key", "left").withColumns({
        "parent_conv_id": F.coalesce("above", "known"), "ends_sha256": F.coalesce("ends", F.lit(NO_IDS))}).select(*columns)
    return done.unionByName(inner)


def prefix_trie(conversations: DataFrame, width: int = BAND, block: int = BLOCK) -> DataFrame:
    """`nodes` of the conversations as they are: (conv_id, turn, role, text), NULL role or text as empty.

    Turns stand by `turn`, NULL first, then by the digest of role and text; repeated rows are repeated turns. Rows without
    a conv_id are in no conversation, other columns are not read, an empty table has no nodes.
    """
    return nodes(turn_runs(conversations, width), width, block)


def family_trie(conversations: DataFrame, width: int = BAND, block: int = BLOCK) -> DataFrame:
    """`prefix_trie` of conversations that begin like the first of their family, see `with_family_opening`."""
    return nodes(with_family_opening(turn_runs(conversations, width)), width, block)


CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)),
    4294967295)"""


def oracle() -> str:
    """DuckDB SQL that compares every node with every conversation that passes it."""
    return f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id AS c, conv_id - conv_id % 5 AS base, {CRC32.format("conv_id")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM turns)),
kept AS (
  SELECT c, 0 AS part, place, role, text FROM convs JOIN turns ON turns.conv_id = base WHERE place <= h
  UNION ALL SELECT c, 1, place, role, text FROM convs JOIN turns ON turns.conv_id = c WHERE place > h),
rebuilt AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, place) AS d, sha256(strlen(role) || ':' || role || text) AS turn, strlen(text) AS size FROM kept),
paths AS (
  SELECT c, 0 AS d, '' AS path, NULL AS above, 0 AS size FROM convs
  UNION ALL
  SELECT c, d, sha256(string_agg(turn, ',') OVER w), CASE WHEN d = 1 THEN '' ELSE sha256(string_agg(turn, ',') OVER (PARTITION BY c ORDER BY d
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) END, size FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY d)),
lengths AS (SELECT c, max(d) AS n FROM paths GROUP BY c),
own AS (
  SELECT d, path, any_value(above) AS above, min(c) AS c, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends FROM paths JOIN lengths USING (c) GROUP BY d, path),
children AS (SELECT above, count(*) AS n FROM own WHERE d > 0 GROUP BY above),
under AS (  -- every node and each node on the way to it, seen along its smallest conversation
  SELECT p.path AS top, o.saved, o.path NOT IN (SELECT above FROM children) AS leaf FROM own o JOIN paths p ON p.c = o.c AND p.d <= o.d),
sums AS (SELECT top, sum(saved) AS saved, count(*) FILTER (leaf) AS leaves FROM under GROUP BY top)
SELECT o.c AS conv_id, o.d::BIGINT AS depth, p.c AS parent_conv_id, o.n_convs, coalesce(k.n, 0) AS n_children, s.leaves AS n_leaves,
  s.saved::BIGINT AS saved_tokens, o.ends AS ends_sha256
FROM own o JOIN sums s ON s.top = o.path LEFT JOIN children k ON k.above = o.path LEFT JOIN own p ON p.path = o.above AND o.d > 0"""
