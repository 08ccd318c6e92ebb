"""Best-two-fit packing of token pieces into sequences of a fixed size."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tracewright.llm.bpe import LibraryBpe, load
from tracewright.llm.common import full_text, groups_for
from tracewright.scale import checkpoint

CAPACITY = 4_096
GROUP = 32_768  # pieces packed together; each group may leave its last sequences part empty


def pieces(
    docs: DataFrame, spec: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """id, piece, start, length and ids_crc32 of every piece of every document.

    A document's ids end with ``end_id``; only documents above the capacity are cut.
    Null and empty texts are the end id alone.
    """
    rows = docs.select(docs[id_col].alias("id"), full_text(docs[text_col]).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(shared.value, LibraryBpe)
        for b in batches:
            for low in range(0, b.num_rows, 256):
                part = b.slice(low, 256)
                out: list[tuple] = []
                for i, ids in enumerate(bpe.pack(part.column(1).to_pylist())):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[at: at + 4 * capacity]
                        out.append((i, k, at // 4, len(cut) // 4, zlib.crc32(cut)))
                at, k, start, length, crc = map(list, zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(at)), pa.array(k, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["id", "piece", "start", "length", "ids_crc32"])
        bpe.forget()
        pa.default_memory_pool().release_unused()

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


class _Pools:
    """Items by a whole number; finds the nearest number that has one."""

    def __init__(self, limit: int):
        self.items: list[list[int]] = [[] for _ in range(limit + 1)]
        self.count = np.zeros(limit + 1, np.int64)
        self.there = 0  # bit n: there is an item of number n

    def put(self, n: int, item: int) -> None:
        self.items[n].append(item)
        self.count[n] += 1
        self.there |= 1 << n

    def take(self, n: int) -> int:
        self.count[n] -= 1
        if not self.count[n]:
            self.there &= ~(1 << n)
        return self.items[n].pop()

    def most(self, limit: int) -> int:
        """The largest number up to the limit, or -1."""
        return (self.there & ((1 << (limit + 1)) - 1)).bit_length() - 1

    def least(self, limit: int) -> int:
        """The smallest number from the limit on, or -1."""
        above = self.there >> limit
        return limit + (above & -above).bit_length() - 1 if above else -1


def best_two_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers; every length is from 1 to the capacity.

    First the items above a sixth of the capacity: a bin takes the longest item left,
    then again and again the longest that fits. When none fits and there is a gap,
    the bin's smallest item is put back for the two left-over items that fill the
    widened gap best, if they fill it better than the item did. Then the short items,
    longest first, each into the bin whose gap it fits most tightly.
    """
    left, short = _Pools(capacity), []
    for i in np.argsort(lengths, kind="stable")[::-1]:
        if 6 * lengths[i] > capacity:
            left.put(int(lengths[i]), int(i))
        else:
            short.append(int(i))
    sizes = np.arange(capacity + 1)
    bins: list[list[int]] = []
    gaps = _Pools(capacity)
    while left.there:
        items, gap = [], capacity
        while gap and (n := left.most(gap)) > 0:
            items.append((n, left.take(n)))
            gap -= n
        if gap and len(items) > 1 and left.there:
            small = items[-1][0]  # items come in falling length
            wide = gap + small
            count = left.count[: wide + 1]
            below = np.maximum.accumulate(np.where(count > 0, sizes[: wide + 1], 0))
            a = np.flatnonzero(count)
            b = below[np.minimum(wide - a, np.where(count[a] > 1, a, a - 1))]
            both = np.where(b > 0, a + b, 0)
            k = int(np.argmax(both)) if len(both) else -1
            if k >= 0 and both[k] > small:
                n, back = items.pop()
                items += [(int(x), left.take(int(x))) for x in (a[k], b[k])]
                left.put(n, back)
                gap = wide - int(both[k])
        gaps.put(gap, len(bins))
        bins.append([i for _, i in items])
    for i in short:
        n = int(lengths[i])
        gap = gaps.least(n)
        if gap < 0:
            gap, k = capacity, len(bins)
            bins.append([])
        else:
            k = gaps.take(gap)
        bins[k].append(i)
        gaps.put(gap - n, k)
    return bins


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to the rows of ``pieces``.

    Pieces are dealt evenly, row by row, to groups of about ``GROUP``, so neither a
    hot key nor the size of the input makes a group larger, and each is packed by
    itself; a sequence belongs to one group. Offsets are gapless from 0. Repeated rows
    are packed as often as they stand there. No pieces, no rows.
    """
    cut = checkpoint(cut)
    groups = groups_for(cut.count(), GROUP)
    schema = cut.schema.add("sequence_id", "long").add("offset", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        t = pa.Table.from_batches(held)
        t = t.sort_by([("length", "ascending"), ("id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = t["length"].to_numpy()
        sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
        first = TaskContext.get().partitionId() << 32
        for k, items in enumerate(best_two_fit(lengths, capacity)):
            ends = np.cumsum(lengths[items])
            sequence[items], offset[items] = first + k, ends - lengths[items]
        t = t.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))
        yield from t.to_batches(max_chunksize=10_000)

    return cut.repartition(groups).mapInArrow(run, schema)
