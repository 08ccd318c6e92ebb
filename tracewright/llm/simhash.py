"""SimHash near-duplicates by covering the space of fingerprints with anchor points.

Anchors are the words of a covering code: two perfect Golay codes of length 23, side
by side over the low 46 bits of a fingerprint. Every 23-bit half is within 3 bits of
exactly one codeword, so a fingerprint has one home anchor. If two fingerprints
differ in at most ``THRESHOLD`` bits, t1 of them in the first half and t2 in the
second, the home of one is within 3 + t1 and 3 + t2 bits of the other. So each
fingerprint is replicated to all anchors within covering radius plus threshold (61
on average), and compared there with the fingerprints that are at home.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import full_text
from tracewright.llm.components import components
from tracewright.scale import broadcast_if_small, checkpoint

THRESHOLD = 2
HALF, RADIUS = 23, 3
GENERATOR = 0xAE3  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
REST = 64 - 2 * HALF
HOT_HOMES = 4_096  # an anchor with more fingerprints at home is divided by the other 18 bits
SEED = 42
PAIRS = 1 << 21  # compared at once
BLOCK = 65_536  # words hashed at once


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of a UTF-8 text as a signed long: XXH64 of each word shingle, majority per bit."""
    words = text.lower().split()  # of bytes: only A-Z is lowered, only \\x20 \\x09-\\x0D separate
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for start in range(0, n, BLOCK):
        part = words[start: start + BLOCK + width - 1]
        shingles = zip(*(part[k:] for k in range(width))) if len(words) >= width else [part]
        ones += _ones(np.array([digest(join(s), SEED) for s in shingles], np.uint64))
    return _packed(2 * ones > n)


def majority(hashes: np.ndarray) -> int:
    """Fingerprint of hashes (uint64) as a signed long: the bits that are set in over half of them."""
    ones = sum((_ones(hashes[low: low + BLOCK]) for low in range(0, len(hashes), BLOCK)), np.zeros(64, np.int64))
    return _packed(2 * ones > len(hashes))


def _ones(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _packed(bits: np.ndarray) -> int:
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint (signed long) of every row, from its whole text; null text: zero."""
    rows = docs.select(docs[id_col].alias("id"), full_text(docs[text_col]).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.int64())], ["id", "fp"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, fp long")


@cache
def _syndromes() -> np.ndarray:
    """Remainder modulo the generator for each of the three bytes of a half."""
    out = np.zeros((3, 256), np.int64)
    for byte in range(3):
        for value in range(256):
            r = value << (8 * byte)
            for bit in range(23, 10, -1):
                if r >> bit & 1:
                    r ^= GENERATOR << (bit - 11)
            out[byte, value] = r
    return out


@cache
def _patterns() -> list[tuple[np.ndarray, np.ndarray]]:
    """For each number of bits beyond the radius: (start of each syndrome's list, error patterns)."""
    table, levels = _syndromes(), []
    for low, high in ((0, RADIUS), *((RADIUS + t, RADIUS + t) for t in range(1, THRESHOLD + 1))):
        words = np.array([sum(1 << i for i in c) for k in range(low, high + 1) for c in combinations(range(HALF), k)])
        s = _syndrome(words, table)
        order = np.argsort(s, kind="stable")
        levels.append((np.searchsorted(s[order], np.arange(2049)), words[order]))
    return levels


def _syndrome(half: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[0, half & 255] ^ table[1, half >> 8 & 255] ^ table[2, half >> 16]


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, bits spent) for each anchor that each fingerprint (int64) goes to; home: none spent."""
    mask = (1 << HALF) - 1
    first, second = fp & mask, fp >> HALF & mask
    s1, s2 = _syndrome(first, _syndromes()), _syndrome(second, _syndromes())
    rows, keys, spent = [], [], []
    for t1 in range(THRESHOLD + 1):
        starts1, words1 = _patterns()[t1]
        n1 = starts1[s1 + 1] - starts1[s1]
        for t2 in range(THRESHOLD + 1 - t1):
            starts2, words2 = _patterns()[t2]
            n2 = starts2[s2 + 1] - starts2[s2]
            row = np.repeat(np.arange(len(fp)), n1 * n2)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n1 * n2) - n1 * n2, n1 * n2)
            c1 = first[row] ^ words1[starts1[s1[row]] + k // n2[row]]
            c2 = second[row] ^ words2[starts2[s2[row]] + k % n2[row]]
            rows.append(row)
            keys.append(c1 | c2 << HALF)
            spent.append(np.full(len(row), t1 + t2, np.int32))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(spent)


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy()
        for start in range(0, len(fp), 4_096):
            part = fp[start: start + 4_096]
            row, key, spent = anchors(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array(spent), pa.array(part[row])], ["anchor", "spent", "fp"])


def _homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = _patterns()[0][1]  # one pattern for each syndrome: from a half to its codeword
    mask = (1 << HALF) - 1
    for b in batches:
        fp = b.column(0).to_numpy()
        halves = [fp & mask, fp >> HALF & mask]
        low, high = (h ^ first[_syndrome(h, _syndromes())] for h in halves)
        yield pa.RecordBatch.from_arrays([pa.array(low | high << HALF)], ["anchor"])


def _divide_hot(replicas: DataFrame, fps: DataFrame) -> DataFrame:
    """Adds ``part``: null, or at anchors with many at home a value of the other 18 bits.

    There a fingerprint at home has one part, and the others go to each part that the
    bits they have not spent allow. So no group of an anchor grows without bound: all
    that share an anchor and a part differ within two 23-bit halves.
    """
    homes = fps.select("fp").mapInArrow(_homes, "anchor long")
    hot = homes.groupBy("anchor").count().where(F.col("count") > HOT_HOMES)
    hot = checkpoint(hot.select("anchor"))
    if hot.isEmpty():
        return replicas.withColumn("part", F.lit(None).cast("long"))
    flips = [[0]] + [[sum(1 << i for i in c) for c in combinations(range(REST), k)] for k in range(1, THRESHOLD + 1)]
    within = [F.array(*[F.lit(x).cast("long") for k in range(n + 1) for x in flips[k]]) for n in range(THRESHOLD + 1)]
    rest = F.shiftrightunsigned("fp", 2 * HALF)
    # A row goes to the parts that its unspent bits reach; only in its own part it is at home.
    reach = F.when(F.col("spent") == 0, within[THRESHOLD])
    for t in range(1, THRESHOLD + 1):
        reach = reach.when(F.col("spent") == t, within[THRESHOLD - t])
    marked = replicas.join(broadcast_if_small(hot.withColumn("hot", F.lit(True))), "anchor", "left")
    calm = marked.where("hot IS NULL").select(*replicas.columns, F.lit(None).cast("long").alias("part"))
    busy = marked.where("hot").withColumn("flip", F.explode(reach)).select(
        "anchor", F.when(F.col("flip") == 0, F.col("spent")).otherwise(F.lit(THRESHOLD)).alias("spent"),
        "fp", rest.bitwiseXOR(F.col("flip")).alias("part"),
    )
    return calm.unionByName(busy)


def _near(homes: np.ndarray, first: np.ndarray, count: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Links (a, b) that connect each row with all homes near it, at most one per row and neighbouring homes.

    ``first`` and ``count`` tell where the homes of each row's anchor stand in ``homes``.
    A row is linked to its first near home, and that one to the next, so that a group
    of many near rows gives a chain and not all its pairs.
    """
    row = np.repeat(np.arange(len(fp)), count)
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + first[row]
    close = np.bitwise_count((homes[at] ^ fp[row]).view(np.uint64)) <= THRESHOLD
    row, home = row[close], homes[at[close]]
    fresh = np.ones(len(row), bool)
    fresh[1:] = row[1:] != row[:-1]
    other = np.where(fresh, fp[row], np.roll(home, 1))
    links = np.stack([np.minimum(home, other), np.maximum(home, other)], axis=1)
    return np.unique(links[links[:, 0] != links[:, 1]], axis=0)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within each (anchor, part); rows come sorted by it, homes first."""
    held: list[np.ndarray] = []
    kept = 0

    def links(table: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.ones(len(table), bool)
        new[1:] = (table[1:, :2] != table[:-1, :2]).any(axis=1)
        run = np.cumsum(new) - 1
        start = np.flatnonzero(new)
        n_homes = np.bincount(run, weights=table[:, 2] == 0, minlength=len(start)).astype(np.int64)
        use = n_homes[run] > 0
        first, count, fp = start[run][use], n_homes[run][use], table[use, 3]
        low = 0
        total = np.cumsum(count)
        while low < len(fp):
            high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + PAIRS, "right")))
            found = _near(table[:, 3], first[low:high], count[low:high], fp[low:high])
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["u", "v"])
            low = high

    for b in batches:
        held.append(np.stack([b.column(0).to_numpy(), b.column(1).fill_null(-1).to_numpy(),
                              b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy()], axis=1))
        kept += len(held[-1])
        if kept >= 1 << 16:
            table = np.concatenate(held)
            last = table[-1, :2]
            whole = int(np.searchsorted((table[:, :2] == last).all(axis=1), True))
            yield from links(table[:whole])
            held, kept = [table[whole:]], 0
    if held:
        yield from links(np.concatenate(held))


def near_links(fps: DataFrame) -> DataFrame:
    """Pairs (u, v) of distinct fingerprints (``fp``) that connect all within the threshold."""
    replicas = fps.select("fp").mapInArrow(_replicate, "anchor long, spent int, fp long")
    replicas = _divide_hot(replicas, fps)
    dealt = replicas.select("anchor", "part", "spent", "fp").repartition("anchor", "part")
    found = dealt.sortWithinPartitions("anchor", "part", "spent", "fp").mapInArrow(_compare, "u long, v long")
    return found.distinct()


def near_classes(fps: DataFrame) -> DataFrame:
    """Rows of distinct fingerprints (``fp``) with ``root``, the least fingerprint that links reach."""
    roots = components(near_links(fps))
    return fps.join(roots, fps["fp"] == roots["node"], "left").select(*fps.columns, F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (signed long) and component_id of every row.

    Rows whose fingerprints differ in at most two bits are linked; component_id is
    the smallest id that links reach (null ids don't count; null if there is no
    other). Null, empty and blank texts have fingerprint zero and are linked like any
    other. Repeated rows are rows. An empty table gives an empty result.

    Copies share a fingerprint and are reduced to one row before anything is
    replicated; rows come back in a join whose hot side Spark splits.
    """
    rows = checkpoint(fingerprints(docs, id_col, text_col))
    fps = checkpoint(rows.groupBy("fp").agg(F.min("id").alias("least")))
    labelled = near_classes(fps)
    ids = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = labelled.join(ids, "root").select(F.col("fp").alias("class_fp"), "component_id")
    return rows.join(classes, rows["fp"] == classes["class_fp"]).select("id", "fp", "component_id")
