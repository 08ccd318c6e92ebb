"""Groups of texts by Jaccard similarity of word shingles, checked exactly.

Two methods propose. The SimHash anchors of ``simhash`` put the fingerprints of the
shingle sets that are within two bits into one class. Texts of similarity 0.8 differ in
up to fifteen bits of 64, more than anchors can cover, so min-hashes propose as well:
``BANDS`` keys of ``ROWS`` min-hashes each, so that a pair at the least similarity shares
no key with probability (1 - 0.8**5)**40, about 1e-7. Every pair that links is compared
by its whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracewright.llm.common import full_text
from tracewright.llm.components import components
from tracewright.llm.simhash import majority, near_classes
from tracewright.scale import checkpoint

WIDTH, LEAST = 5, 0.8
BANDS, ROWS = 40, 5
SEED = 42
BLOCK = 8_192  # shingles min-hashed at once
SLOTS = 256  # shingles are counted by their hash in so many slots, to bound what two sets share
BLOCK_NODES, BLOCK_SHINGLES = 4_096, 4_000_000  # of sets that one task compares at once

_DRAWN = np.random.default_rng(SEED).integers(0, 2**64, (2, BANDS * ROWS, 1), np.uint64)
_FLIP, _TIMES = _DRAWN[0], _DRAWN[1] | np.uint64(1)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Distinct XXH64 of the word shingles, sorted; a text of fewer words has one, of all its words."""
    words = text.lower().encode("utf-8", "replace").split()
    digest, join = xxhash.xxh64_intdigest, b" ".join
    runs = zip(*(words[k:] for k in range(width))) if len(words) >= width else [words]
    return np.unique(np.array([digest(join(s), SEED) for s in runs], np.uint64))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def _bands(found: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for low in range(0, len(found), BLOCK):
        drawn = (found[None, low: low + BLOCK] ^ _FLIP) * _TIMES
        np.minimum(least, (drawn ^ drawn >> np.uint64(32)).min(axis=1), out=least)
    parts = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(p.tobytes(), k) for k, p in enumerate(parts)], np.uint64).view(np.int64)


def _counts(found: np.ndarray) -> bytes:
    """Shingles per slot; 255 stands for any number from there on."""
    return np.minimum(np.bincount((found >> np.uint64(56)).astype(np.intp), minlength=SLOTS), 255).astype(np.uint8).tobytes()


def may_be_close(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether sets may be alike, by rows of slot counts: they share at most the lesser count of each slot."""
    least = np.minimum(a, b)
    shared = np.where((least == 255).any(axis=1), np.minimum(size_a, size_b), least.sum(axis=1, dtype=np.int64))
    return shared >= LEAST * (size_a + size_b - shared) - 1e-6


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingles(t) for t in b.column(2).to_pylist()]
        node = [xxhash.xxh3_128_digest(s.tobytes(), SEED) for s in sets]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(node, pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
             pa.array([majority(s) for s in sets], pa.int64()), pa.array([_bands(s) for s in sets], pa.list_(pa.int64()))],
            ["id", "digest", "node", "size", "fp", "keys"])


def close_links(sets: list[np.ndarray], side: list[int]) -> list[tuple[int, int]]:
    """Pairs (positions) of similarity 0.8 or more that connect all such pairs.

    ``side`` 0 and 1: only pairs of one with the other; None in all: all pairs. Pairs
    that links connect already are not compared, nor those whose sizes or slot counts
    rule it out.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    size = np.array([len(sets[i]) for i in order])
    slots = np.frombuffer(b"".join(_counts(sets[i]) for i in order), np.uint8).reshape(-1, SLOTS)
    half = np.array([-1 if side[i] is None else side[i] for i in order])
    last = np.searchsorted(size, np.floor(size / LEAST + 1e-6), "right")
    root = np.arange(len(order))
    links = []
    for i in range(len(order)):
        met = np.arange(i + 1, last[i])
        met = met[(root[met] != root[i]) & ((half[met] != half[i]) | (half[i] < 0))]
        if not len(met):
            continue
        for j in met[may_be_close(slots[i], slots[met], size[i], size[met])]:
            if root[j] != root[i] and similarity(sets[order[i]], sets[order[j]]) >= LEAST:
                root[root == root[j]] = root[i]
                links.append((int(order[i]), int(order[j])))
    return links


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each block; rows come sorted by block."""
    block, nodes, sets, sides = None, [], [], []

    def found() -> Iterator[pa.RecordBatch]:
        links = close_links(sets, sides) if len(sets) > 1 else []
        if links:
            yield pa.RecordBatch.from_arrays(
                [pa.array([nodes[p[k]] for p in links], pa.binary()) for k in (0, 1)], ["u", "v"])

    for b in batches:
        for name, node, side, text in zip(*(b.column(k).to_pylist() for k in range(4))):
            if name != block:
                yield from found()
                block, nodes, sets, sides = name, [], [], []
            nodes.append(node)
            sides.append(side)
            sets.append(shingles(text))
    yield from found()


def _blocks(nodes: DataFrame) -> DataFrame:
    """block, node, side: each pair that shares a key is in a block, on both sides if they are told apart.

    Nodes that keys connect are one block. Where that would be too much for one task,
    each key is a block, and a key that is still too much is dealt into cells: each two
    of them are a block, compared with each other only, and so is each cell.
    """
    members = nodes.select(F.posexplode(F.concat("keys", F.array("class"))).alias("band", "key"), "node")
    first = F.first("node").over(W.partitionBy("band", "key").orderBy("node").rowsBetween(W.unboundedPreceding, W.currentRow))
    edges = checkpoint(members.select(F.col("node").alias("u"), first.alias("v")).where("u > v").distinct())
    held = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    roots = components(edges).select(F.col("node").alias("n"), "root")
    held = checkpoint(held.join(roots, F.col("node") == F.col("n"), "left").select("node", F.coalesce("root", "node").alias("root"))
                      .join(nodes.select("node", "size"), "node"))

    def cells(nodes_each: int, shingles_each: int) -> Column:
        return F.ceil(F.greatest(F.count("*") / nodes_each, F.sum("size") / shingles_each)).cast("int")

    big = held.groupBy("root").agg(cells(BLOCK_NODES, BLOCK_SHINGLES).alias("cells")).where("cells > 1")
    big = checkpoint(big.select(F.col("root").alias("of")))
    whole = held.select(F.hex("root").alias("block"), "node", F.lit(None).cast("int").alias("side"))
    if big.isEmpty():
        return whole
    whole = held.join(big, F.col("root") == F.col("of"), "left_anti").select(
        F.hex("root").alias("block"), "node", F.lit(None).cast("int").alias("side"))
    inside = held.join(big, F.col("root") == F.col("of"), "left_semi").select(F.col("node").alias("n"), "size")
    inside = checkpoint(members.join(inside, F.col("node") == F.col("n")).select("band", "key", "node", "size"))
    keys = inside.groupBy(F.col("band").alias("b"), F.col("key").alias("k")).agg(
        F.count("*").alias("n"), F.greatest(F.lit(1), cells(BLOCK_NODES // 2, BLOCK_SHINGLES // 2)).alias("cells")).where("n > 1")
    dealt = inside.join(keys, (F.col("band") == F.col("b")) & (F.col("key") == F.col("k")))
    dealt = dealt.withColumn("cell", F.pmod(F.xxhash64("node", "key"), F.col("cells")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    side = F.when(F.col("cell") != F.col("other"), (F.col("cell") > F.col("other")).cast("int"))
    name = F.concat_ws(" ", "band", "key", F.least("cell", "other"), F.greatest("cell", "other"))
    return whole.unionByName(dealt.select(name.alias("block"), "node", side.alias("side")))


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and component_id of every row.

    Rows are linked whose sets of five-word shingles (lower case; all words if fewer)
    have a Jaccard similarity of 0.8 or more; component_id is the smallest id that
    links reach (null ids don't count; null if there is no other). Null, empty and
    blank texts are equal to each other only. Repeated rows are rows; an empty table
    gives an empty result. Whole texts are read.

    Equal sets are reduced to one node. Nodes that share a key, of min-hashes or of the
    anchors, meet in one block of bounded size and are compared there; only links that
    connect them leave it. So a group of many near copies makes as many rows as it has
    members, and each of its texts moves once.
    """
    text = full_text(docs[text_col])
    texts = docs.select(docs[id_col].alias("id"), F.md5(text).alias("digest"), text.alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    rows = checkpoint(texts.mapInArrow(_propose, f"id {kind}, digest string, node binary, size long, fp long, keys array<long>"))
    nodes = checkpoint(rows.groupBy("node").agg(
        F.min("id").alias("least"), F.min("digest").alias("digest"), F.min("size").alias("size"), F.min("fp").alias("fp"), F.first("keys").alias("keys")))
    classes = near_classes(nodes.select("fp").distinct()).withColumnRenamed("fp", "of")
    classed = nodes.join(classes, nodes["fp"] == classes["of"]).withColumnRenamed("root", "class")
    blocks = checkpoint(_blocks(checkpoint(classed.select("node", "size", "class", "keys"))))
    asked = blocks.select(F.col("node").alias("n")).distinct()
    asked = nodes.join(asked, F.col("node") == F.col("n"), "left_semi").select("node", F.col("digest").alias("of"))
    found = texts.join(asked, texts["digest"] == asked["of"]).groupBy(F.col("node").alias("n")).agg(F.first("text").alias("text"))
    met = blocks.join(found, F.col("node") == F.col("n")).select("block", "node", "side", "text")
    links = met.repartition("block").sortWithinPartitions("block").mapInArrow(_compare, "u binary, v binary")
    roots = components(links).select(F.col("node").alias("n"), F.col("root").alias("to"))
    labelled = nodes.select("node", "least").join(roots, F.col("node") == F.col("n"), "left")
    labelled = checkpoint(labelled.select("node", "least", F.coalesce("to", "node").alias("root")))
    best = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = labelled.join(best, "root").select(F.col("node").alias("class_node"), "component_id")
    return rows.join(groups, rows["node"] == groups["class_node"]).select("id", "component_id")
