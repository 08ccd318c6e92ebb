"""Merkle manifest of a dataset by time-forward processing.

Nodes are labelled (tree, level, place). The queue of messages between them is a
table: Spark sorts it by label and spills it, so it may be of any size. One sweep
takes the messages of a *chunk*, the ``FAN ** LEVELS`` nodes below one node ``LEVELS``
levels up, and works the levels in between off a heap in the order of the labels;
what leaves the chunk is a message of the next sweep. The reversed sweeps hand each
node's proof suffix down, from the root to the leaves.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tracewright.llm.places import placed
from tracewright.scale import checkpoint

FAN = 16
LEVELS = 3  # worked off in one sweep; a chunk has FAN ** LEVELS nodes at most
CHUNK = FAN**LEVELS
Step = tuple[bytes, bytes]  # digests of the siblings on the left and on the right, as hex text


def record_hash(columns: Sequence[Column]) -> Column:
    """SHA-256 of a row as hex text: each value ``-`` if null, else its bytes counted, ``:``, the value."""
    text = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(
        F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]), 256)


def levels_of(n: int) -> int:
    """Levels above ``n`` nodes, until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def forward(digests: Sequence[bytes], levels: int) -> list[list[bytes]]:
    """Digests of a chunk, level by level; ``levels`` more levels, each by runs of ``FAN``."""
    queue = [(0, i, d) for i, d in enumerate(digests)]  # sorted, so it is a heap
    out: list[list[bytes]] = [[] for _ in range(levels + 1)]
    run: list[bytes] = []
    while queue:
        level, i, digest = heapq.heappop(queue)
        out[level].append(digest)
        if level == levels:
            continue
        run.append(digest)
        if i % FAN == FAN - 1 or not queue or queue[0][0] != level:
            heapq.heappush(queue, (level + 1, i // FAN, sha256(b"".join(run)).hexdigest().encode()))
            run = []
    return out


def backward(nodes: list[list[bytes]], top: list[Step]) -> list[list[Step]]:
    """Proof of every node of the lowest level: steps up to the chunk's top, then those of ``top``."""
    queue: list[tuple[int, int, list[Step]]] = [(1 - len(nodes), 0, top)]
    out: list[list[Step]] = []
    while queue:
        level, i, suffix = heapq.heappop(queue)
        if level == 0:
            out.append(suffix)
            continue
        below = nodes[-level - 1]
        run = below[FAN * i: FAN * (i + 1)]
        for k in range(len(run)):
            heapq.heappush(queue, (level + 1, FAN * i + k, [(b"".join(run[:k]), b"".join(run[k + 1:])), *suffix]))
    return out


def fold(digest: bytes, proof: Sequence[Step]) -> bytes:
    for before, after in proof:
        digest = sha256(before + digest + after).hexdigest().encode()
    return digest


def _chunks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[tuple]]:
    """Rows that agree in the first ``width`` columns; they come side by side."""
    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
    for _, same in groupby(rows, lambda row: row[:width]):
        yield list(same)


def _by_label(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("grp", "chunk").sortWithinPartitions("grp", "chunk", "pos")


def _out(schema: pa.Schema, rows: Iterator[tuple], size: int = 4_096) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _up(nodes: DataFrame) -> DataFrame:
    """The next messages: each chunk's top, with its place and the nodes left in its tree."""
    schema = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for rows in _chunks(batches, 2):
            grp, chunk, _, n, _ = rows[0]
            top = forward([r[4].encode() for r in rows], min(LEVELS, levels_of(n)))[-1][0]
            yield grp, chunk, -(-n // CHUNK), top.decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _out(schema, tops(batches))

    labelled = nodes.select("grp", F.expr(f"pos div {CHUNK}").alias("chunk"), "pos", "n", "digest")
    return _by_label(labelled).mapInArrow(run, "grp string, pos long, n long, digest string")


def _sweeps(nodes: DataFrame, largest: int) -> list[DataFrame]:
    """The messages of every sweep of trees with ``largest`` nodes at most; the last has one node a tree."""
    sweeps = [nodes]
    while largest > 1:
        sweeps.append(checkpoint(_up(sweeps[-1])))
        largest = -(-largest // CHUNK)
    return sweeps


PROOF = "array<string>"  # left, right, left, right ... from the lowest step on
PATHS = f"grp string, pos long, path {PROOF}, subroot string, root string"


def _steps(path: list[str]) -> list[Step]:
    flat = [p.encode() for p in path]
    return list(zip(flat[::2], flat[1::2]))


def _meet(nodes: DataFrame, tops: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """Nodes of a sweep and the message to each chunk, the message first."""
    empty = [F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in more]
    low = nodes.select(
        "grp", F.expr(f"pos div {CHUNK}").alias("chunk"), "pos", "n", "digest",
        F.lit(None).cast(PROOF).alias("path"), F.lit(None).cast("string").alias("subroot"),
        F.lit(None).cast("string").alias("root"), *more)
    high = tops.select(
        "grp", F.col("pos").alias("chunk"), F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"),
        F.lit("").alias("digest"), "path", "subroot", "root", *empty)
    return _by_label(low.unionByName(high))


def _proofs(rows: list[tuple]) -> tuple[tuple, Iterator[tuple[tuple, list[Step]]]]:
    """The message of a chunk and its nodes, each with its proof."""
    message, nodes = rows[0], rows[1:]
    tree = forward([r[4].encode() for r in nodes], min(LEVELS, levels_of(nodes[0][3])))
    return message, zip(nodes, backward(tree, _steps(message[5])))


def _down(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """Proof suffixes of the nodes of a sweep, from those of the chunks' tops."""
    schema = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("path", pa.list_(pa.string())),
                        ("subroot", pa.string()), ("root", pa.string())])

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for rows in _chunks(batches, 2):
            message, proofs = _proofs(rows)
            for node, proof in proofs:
                yield node[0], node[2], [x.decode() for step in proof for x in step], message[6], message[7]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _out(schema, paths(batches), 256)

    return _meet(nodes, tops).mapInArrow(run, PATHS)


def _leaves(nodes: DataFrame, tops: DataFrame) -> DataFrame:
    """What is told of every leaf."""
    schema = pa.schema([("id", to_arrow_type(nodes.schema["id"].dataType)), *[
        (c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]])

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for rows in _chunks(batches, 2):
            message, proofs = _proofs(rows)
            for node, proof in proofs:
                held = sha256(b"".join(x for step in proof for x in step)).hexdigest()
                now = fold((node[9] or node[4]).encode(), proof).decode()
                yield node[8], node[4], message[6], message[7], held, now

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _out(schema, told(batches))

    kind = nodes.schema["id"].dataType.simpleString()
    out = _meet(nodes, tops, ["id", "now"]).mapInArrow(
        run, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string")
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def leaves_of(
    docs: DataFrame, columns: Sequence[str], id_col: str = "doc_id", group_col: str = "source",
    found: Sequence[Column] | None = None, changed: Column | None = None,
) -> DataFrame:
    """Leaves of a table for ``manifest``, over ``columns`` as recorded.

    ``found`` holds the same columns as they are found now, where ``changed`` is true;
    nulls in any column are values of their own.
    """
    now = F.lit(None).cast("string")
    if found is not None:
        now = F.when(F.lit(True) if changed is None else changed, record_hash(found))
    return docs.select(
        docs[id_col].alias("id"), docs[group_col].cast("string").alias("grp"),
        record_hash([docs[c] for c in columns]).alias("digest"), now.alias("now"))


def manifest(leaves: DataFrame) -> DataFrame:
    """Roots, proof and verdict of every leaf of ``leaves`` (id, grp, digest, now).

    ``digest`` is the leaf as recorded, ``now`` as it is found, null where nothing
    changed; both hex text. Per ``grp`` (text) leaves ascend by id, null first, then
    by digest; ``FAN`` consecutive nodes become one until one remains, the subroot (a
    lone leaf itself). Subroots, by grp (null first, then by UTF-8 bytes), give the
    root likewise. Columns: id, leaf, subroot, root, proof_sha256 (of all siblings,
    from the leaf's run up, left to right), folded_root (from ``now``, else
    ``digest``, and the siblings), verified (it equals root). Repeated rows are leaves
    of their own; no leaves, no rows.

    A group of any size is spread: places come from a sort by ranges, and every
    message goes to the chunk of its label, at most ``CHUNK`` rows.
    """
    nodes = checkpoint(placed(leaves, ["grp"], ["id", "digest"]))
    largest = nodes.agg(F.max("n")).first()[0] or 0
    trees = _sweeps(nodes, largest)
    subroots = trees[-1].select(F.col("grp").alias("of"), "digest")
    top = checkpoint(placed(subroots, [], ["of"]).withColumn("grp", F.lit("")))
    roofs = _sweeps(top, top.count())

    nothing = F.array().cast(PROOF)
    paths = roofs[-1].select("grp", "pos", nothing.alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    for sweep in reversed(roofs[:-1]):
        paths = checkpoint(_down(sweep, paths))
    named = top.select("pos", F.col("of").alias("grp"), "digest").join(paths.select("pos", "path", "root"), "pos")
    paths = named.select("grp", F.lit(0).cast("long").alias("pos"), "path", F.col("digest").alias("subroot"), "root")
    for sweep in reversed(trees[1:-1]):
        paths = checkpoint(_down(sweep, paths))
    return _leaves(trees[0], paths)
