"""Prefix trie of conversations over vertical bitmaps.

Conversations are dealt to shards by ranges of their number. A shard's index holds, for
each (position, turn), the bitset of its conversations with that turn there; a node's
children are the intersections of its bitset with the postings of the next position,
depth first. Nodes of several shards meet by the hash of their turns.

Only positions that a conversation can share with another are walked that way: from its
first turn that stands at that position in no other one on, it is alone, and its nodes
are told from its rows. So the walk costs what is shared, and a very long
conversation is spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracewright.llm.common import full_text, words
from tracewright.llm.places import placed
from tracewright.scale import broadcast_if_small, checkpoint

SHARD = 512  # conversations whose bitsets are walked together
WINDOW = 256  # positions held at once
ROOT = sha256(b"").digest()


def cells(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, pos (from 0), n (turns of the conversation), cell (hash of role and text) and words of every turn.

    Turns are in order of ``turn`` (null first), then role, then the hash of role and text, so
    ties and repeated rows have one order. Null roles and texts are empty; rows
    without ``conv`` belong to no conversation and are left out.
    """
    r, t = full_text(turns[role]), full_text(turns[text])
    cell = F.unhex(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t), 256))
    rows = turns.where(turns[conv].isNotNull()).select(
        turns[conv].cast("long").alias("conv"), turns[turn].alias("turn"), r.alias("role"), cell.alias("cell"),
        F.size(words(t)).cast("long").alias("words"))
    return checkpoint(placed(rows, ["conv"], ["turn", "role", "cell"]).select("conv", "pos", "n", "cell", "words"))


def lengths(rows: DataFrame) -> DataFrame:
    """conv and n of every conversation of ``cells``."""
    return rows.groupBy("conv").agg(F.max("n").alias("n"))


def with_openings(rows: DataFrame, step: int, opening: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """``cells`` and ``lengths`` of conversations that open with turns of a neighbour.

    The first ``opening`` turns (a number up to ``most``, from the column conv) of conversation c
    are replaced by those of c - c % step: by all if it has fewer, by none if there is no
    such conversation. A conversation may be left without turns.
    """
    first = F.struct("pos", "cell", "words")
    heads = rows.where((F.col("pos") < most) & (F.col("conv") % step == 0)).groupBy(F.col("conv").alias("base"))
    heads = heads.agg(F.sort_array(F.collect_list(first)).alias("head"))
    convs = lengths(rows).select("conv", "n", opening.cast("int").alias("h"), (F.col("conv") - F.col("conv") % step).alias("of"))
    convs = convs.join(heads, F.col("of") == F.col("base"), "left")
    taken = F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h"))
    convs = checkpoint(convs.select("conv", "n", "h", taken.alias("taken")))
    size = F.size("taken")
    new = convs.select("conv", (size + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("n"), F.explode("taken").alias("t"))
    opened = new.select("conv", "t.pos", "n", "t.cell", "t.words")
    # Only a neighbour with fewer turns than asked for moves the others.
    moved = convs.where((size < F.col("h")) & (F.col("n") > F.col("h"))).select(F.col("conv").alias("c"), (F.col("h") - size).alias("by"))
    own = rows.where(F.col("pos") >= opening).join(broadcast_if_small(moved), F.col("conv") == F.col("c"), "left")
    by = F.coalesce("by", F.lit(0))
    own = own.select("conv", (F.col("pos") - by).alias("pos"), (F.col("n") - by).alias("n"), "cell", "words")
    return opened.unionByName(own), convs.select("conv", (size + F.greatest(F.col("n") - F.col("h"), F.lit(0))).cast("long").alias("n"))


def bits(of: int) -> Iterator[int]:
    """Places of the set bits, ascending."""
    while of:
        low = of & -of
        yield low.bit_length() - 1
        of ^= low


class Shard:
    """Bitmaps of one shard, walked window by window."""

    def __init__(self, convs: list[tuple[int, int, int]]):
        """(conv, turns, leading turns that may be shared) in ascending order."""
        self.convs = [c for c, _, _ in convs]
        self.place = {c: i for i, c in enumerate(self.convs)}
        self.done: dict[int, int] = {}  # depth: conversations that end there
        self.alone: dict[int, int] = {}  # depth: conversations that go on alone
        for i, (_, n, shared) in enumerate(convs):
            to = self.done if n == shared else self.alone
            to[shared] = to.get(shared, 0) | 1 << i
        self.open = [((1 << len(convs)) - 1, ROOT, 0)]  # bitset, hash, depth
        self.root = (ROOT, None, 0, 0, *self._lists(self.open[0][0], 0))

    def _lists(self, members: int, depth: int) -> list[list[int]]:
        each = (members, members & self.done.get(depth, 0), members & self.alone.get(depth, 0))
        return [[self.convs[i] for i in bits(x)] for x in each]

    def walk(self, rows: list[tuple[int, int, bytes, int]]) -> Iterator[tuple]:
        """Nodes of the next positions, from (pos, conv, cell, words): hash, parent, depth, words, members, ends, alone."""
        postings: dict[tuple[int, bytes], int] = {}
        there: dict[int, int] = {}  # position: conversations with a turn
        turn: dict[tuple[int, int], tuple[bytes, int]] = {}
        for pos, conv, cell, n_words in rows:
            i = self.place[conv]
            postings[pos, cell] = postings.get((pos, cell), 0) | 1 << i
            there[pos] = there.get(pos, 0) | 1 << i
            turn[pos, i] = cell, n_words
        stack, self.open = self.open, []
        last = max(there)
        while stack:
            members, node, depth = stack.pop()
            if depth > last:
                self.open.append((members, node, depth))
                continue
            left = members & there.get(depth, 0)
            while left:
                cell, n_words = turn[depth, (left & -left).bit_length() - 1]
                child = members & postings[depth, cell]
                left ^= child
                digest = sha256(node + cell).digest()
                yield digest, node, depth + 1, n_words, *self._lists(child, depth + 1)
                stack.append((child, digest, depth + 1))


NODES = "node binary, parent binary, depth long, words long, shard long, members array<long>, ends array<long>, alone array<long>"


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of every shard; rows come by (shard, pos, conv), those of the conversations themselves at pos -1."""
    longs = pa.list_(pa.int64())
    schema = pa.schema([("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("words", pa.int64()),
                        ("shard", pa.int64()), ("members", longs), ("ends", longs), ("alone", longs)])

    def nodes() -> Iterator[tuple]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        held: Shard | None = None
        for (shard, window), some in groupby(rows, lambda r: (r[0], r[1] // WINDOW)):
            if window < 0:
                held = Shard([(r[2], r[5], r[6]) for r in some])
                found: Iterator[tuple] = iter([held.root])
            else:
                found = held.walk([r[1:5] for r in some])
            for x in found:
                yield *x[:4], shard, *x[4:]

    out: list[tuple] = []
    size = 0
    for x in nodes():
        out.append(x)
        size += 16 + len(x[5])
        if size > 1 << 18:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, comma-joined; rows (node, shard, ids) come by (node, shard), so the ids ascend."""
    node, digest = None, sha256()
    for b in batches:
        out: list[tuple[bytes, str]] = []
        for name, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
            said = ",".join(map(str, ids)).encode()
            if name == node:
                digest.update(b"," + said)
                continue
            if node is not None:
                out.append((node, digest.hexdigest()))
            node, digest = name, sha256(said)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["node", "sha"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([digest.hexdigest()])], ["node", "sha"])


def prefix_trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """All nodes of the trie of conversations, from ``cells`` and ``lengths``.

    A node stands for the conversations that start with the same turns. Columns:
    conv_id (the least of them), depth, parent_conv_id (conv_id of the parent, null at the root),
    n_convs, n_children, n_leaves (childless nodes below or at it), saved_tokens
    ((n_convs - 1) times the words of the node's last turn, over all nodes below or
    at it), ends_sha256 (SHA-256 of the ids that end there, ascending, comma-joined).
    Conversations without turns are members of the root. No conversations, no rows.

    Sums over a subtree need no walk up: a node is owned by its least member, and each
    conversation gives what it owns to all nodes that it passes; what the owner of a
    node owns above it is taken off. Ids that end in one node are hashed in order,
    ``SHARD`` at a time in a stream, as such a hash is by nature.
    """
    postings = rows.groupBy("pos", "cell").agg(F.count("*").alias("k"), F.min("conv").alias("c"))
    lonely = postings.where("k = 1").groupBy("c").agg(F.min("pos").alias("from"))
    known = convs.join(lonely, F.col("conv") == F.col("c"), "left").select("conv", F.col("n").alias("turns"), F.coalesce("from", "n").alias("shared"))
    known = placed(known, [], ["conv"]).select(
        F.col("conv").alias("of"), "turns", "shared", F.expr(f"pos div {SHARD}").alias("shard"))
    return _nodes(rows, checkpoint(known))


def _nodes(rows: DataFrame, known: DataFrame) -> DataFrame:
    met = checkpoint(rows.drop("n").join(known, F.col("conv") == F.col("of")).drop("of"))
    whole = known.select("shard", F.lit(-1).cast("long").alias("pos"), F.col("of").alias("conv"),
                         F.lit(None).cast("binary").alias("cell"), F.lit(0).cast("long").alias("words"), "turns", "shared")
    shared = met.where("pos < shared").select(whole.columns).unionByName(whole)
    walked = shared.repartition("shard").sortWithinPartitions("shard", "pos", "conv").mapInArrow(_walk, NODES)
    walked = checkpoint(walked)

    nodes = walked.select("node", "parent", "depth", "words", F.size("members").cast("long").alias("k"),
                          F.array_min("members").alias("least"), F.size("alone").cast("long").alias("tails"))
    nodes = nodes.groupBy("node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("words").alias("words"),
                                      F.sum("k").alias("n_convs"), F.min("least").alias("owner"), F.sum("tails").alias("tails"))
    nodes = checkpoint(nodes)
    kids = nodes.where("depth > 0").groupBy(F.col("parent").alias("p")).agg(F.count("*").alias("kids"))
    above = nodes.select(F.col("node").alias("up"), F.col("owner").alias("parent_conv_id"))
    value = (F.col("n_convs") - 1) * F.col("words")
    higher = W.partitionBy("owner").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    nodes = nodes.join(kids, F.col("node") == F.col("p"), "left").join(above, F.col("parent") == F.col("up"), "left")
    nodes = checkpoint(nodes.select(
        "node", "depth", "n_convs", "owner", "parent_conv_id", (F.coalesce("kids", F.lit(0)) + F.col("tails")).alias("n_children"),
        value.alias("value"), F.coalesce(F.sum(value).over(higher), F.lit(0)).alias("above")))

    owned = nodes.select(F.col("owner").alias("c"), "value", (F.col("n_children") == 0).cast("long").alias("leaf"))
    tails = known.where("shared < turns").select(F.col("of").alias("c"), F.lit(0).cast("long").alias("value"), F.lit(1).cast("long").alias("leaf"))
    gives = owned.unionByName(tails).groupBy("c").agg(F.sum("value").alias("value"), F.sum("leaf").alias("leaf"))
    gives = gives.where("value > 0 or leaf > 0")
    passed = walked.select(F.col("node").alias("at"), F.explode("members").alias("m")).join(gives, F.col("m") == F.col("c"))
    sums = passed.groupBy("at").agg(F.sum("value").alias("values"), F.sum("leaf").alias("n_leaves"))
    ends = walked.where(F.size("ends") > 0).select("node", "shard", "ends")
    ends = ends.repartition("node").sortWithinPartitions("node", "shard").mapInArrow(_listed, "node binary, sha string")
    ends = ends.select(F.col("node").alias("end"), "sha")
    told = nodes.join(sums, F.col("node") == F.col("at")).join(ends, F.col("node") == F.col("end"), "left").select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("values") - F.col("above")).alias("saved_tokens"), F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))

    left = walked.select(F.col("node").alias("at"), F.explode("alone").alias("m")).join(
        nodes.select("node", F.col("owner").alias("parent_conv_id")), F.col("at") == F.col("node"))
    left = left.select("m", "parent_conv_id")
    tail = met.where("pos >= shared")
    first = tail.where("pos = shared").join(left, F.col("conv") == F.col("m")).drop("m")
    rest = tail.where("pos > shared").withColumn("parent_conv_id", F.col("conv"))
    last = F.col("pos") + 1 == F.col("turns")
    listed = F.when(last, F.col("conv").cast("string")).otherwise("")
    one = F.lit(1).cast("long")
    alone = first.unionByName(rest).select(
        F.col("conv").alias("conv_id"), (F.col("pos") + 1).alias("depth"), "parent_conv_id", one.alias("n_convs"),
        (~last).cast("long").alias("n_children"), one.alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ends_sha256"))
    return told.unionByName(alone)
