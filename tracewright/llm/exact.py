"""Exact de-duplication against an index of digests that were seen before.

The index is a minimal perfect hash: distinct digests of the history are dealt to
buckets by their leading bits, and each bucket of about ``BUCKET`` digests is one
row that holds displacements and slots. A slot holds the full 32-byte digest and
the locator of the winner (id, code points, number of rows). A lookup computes the
slot and compares all bytes; a digest that is not there groups on its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tracewright.llm.common import full_text, groups_for, without_blanks
from tracewright.scale import checkpoint

BUCKET = 16_384  # digests in a bucket, on average
GROUP = 4  # digests that share a displacement, on average


def digest_of(text: Column) -> Column:
    """SHA-256 of a text without blanks, as bytes; null counts as empty."""
    return F.unhex(F.sha2(without_blanks(full_text(text)), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """id, digest (SHA-256 of the text without blanks) and code points of the original text."""
    return docs.select(
        docs[id_col].alias("id"),
        digest_of(docs[text_col]).alias("digest"),
        F.char_length(full_text(docs[text_col])).cast("long").alias("n_chars"),
        *more,
    )


def winners(rows: DataFrame) -> DataFrame:
    """One row per digest: most code points, then smallest id (null last), and the row count."""
    first = F.min(F.struct((-F.col("n_chars")).alias("m"), F.col("id").isNull().alias("none"), "id"))
    return rows.groupBy("digest").agg(first.alias("w"), F.count("*").alias("rows")).select(
        "digest", F.col("w.id").alias("id"), (-F.col("w.m")).alias("n_chars"), "rows"
    )


def _lanes(raw: np.ndarray) -> np.ndarray:
    return raw.reshape(-1, 32).view("<u8")


def _place(lanes: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """Slot of keys under displacements ``d``: a mix of one word of the key and d, below n."""
    x = lanes[:, 2] + (d.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) ^ lanes[:, 3]
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(n)).astype(np.int64)


def build_slots(raw: np.ndarray, max_tries: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """Displacements and the slot of every key for distinct 32-byte keys (rows of ``raw``).

    Groups of keys are placed largest first: the first displacement for which all
    their slots are free is kept. A lone key takes a free slot by its number.
    """
    lanes, n = _lanes(raw), len(raw)
    groups = -(-n // GROUP)
    of = (lanes[:, 1] % np.uint64(groups)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    sizes = np.bincount(of, minlength=groups)
    ends = np.cumsum(sizes)
    moved = np.zeros(groups, np.int64)
    slot, taken = np.empty(n, np.int64), np.zeros(n, bool)
    by_size = np.argsort(-sizes, kind="stable")
    for g in by_size[sizes[by_size] > 1]:
        keys = order[ends[g] - sizes[g]: ends[g]]
        for start in range(0, max_tries, 128):
            at = _place(lanes[keys], np.arange(start, start + 128)[:, None], n)
            line = np.sort(at, axis=1)
            good = ~taken[at].any(axis=1) & (line[:, 1:] != line[:, :-1]).all(axis=1)
            if good.any():
                k = int(np.argmax(good))
                moved[g], slot[keys] = start + k, at[k]
                taken[at[k]] = True
                break
        else:
            raise ValueError("no displacement found: keys are not distinct")
    free = np.flatnonzero(~taken)
    lone = by_size[sizes[by_size] == 1]
    moved[lone] = -1 - free[: len(lone)]
    slot[order[ends[lone] - 1]] = free[: len(lone)]
    return moved, slot


def find_slots(raw: np.ndarray, moved: np.ndarray, n: int) -> np.ndarray:
    """The one slot in which each key can be."""
    lanes = _lanes(raw)
    d = moved[(lanes[:, 1] % np.uint64(len(moved))).astype(np.int64)]
    return np.where(d < 0, -1 - d, _place(lanes, np.maximum(d, 0), n))


def _raw(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _index_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("bucket", T.LongType()), T.StructField("moved", T.BinaryType()),
        T.StructField("digests", T.BinaryType()), T.StructField("ids", T.ArrayType(id_type)),
        T.StructField("n_chars", T.ArrayType(T.LongType())), T.StructField("rows", T.ArrayType(T.LongType())),
    ])


def _bucket(buckets: int):
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(buckets))


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket with its slots, from the ``winners`` of the history."""

    def build(t: pa.Table) -> pa.Table:
        raw = _raw(t["digest"])
        moved, slot = build_slots(raw)
        back = np.argsort(slot)
        t = t.take(pa.array(back))
        return pa.table({
            "bucket": t["bucket"].slice(0, 1), "moved": [moved.tobytes()], "digests": [raw[back].tobytes()],
            "ids": pa.array([t["id"].to_pylist()], pa.list_(t.schema.field("id").type)),
            "n_chars": [t["n_chars"].to_pylist()], "rows": [t["rows"].to_pylist()],
        })

    keyed = history.withColumn("bucket", _bucket(buckets))
    return keyed.groupBy("bucket").applyInArrow(build, _index_schema(history.schema["id"].dataType))


def look_up(index: DataFrame, incoming: DataFrame, buckets: int) -> DataFrame:
    """Every digest of the index or of ``incoming`` (``winners`` of new rows), once.

    Columns: digest, seen (it is in the index), id and n_chars of the winner over
    both sides, rows over both sides.
    """
    schema = T.StructType([
        T.StructField("digest", T.BinaryType()), T.StructField("seen", T.BooleanType()), incoming.schema["id"],
        T.StructField("n_chars", T.LongType()), T.StructField("rows", T.LongType()),
    ])

    def merge(slots: pa.Table, new: pa.Table) -> pa.Table:
        out: list[tuple] = []
        held = slots.to_pylist()[0] if slots.num_rows else None
        old: list[tuple] = []
        if held:
            whole = held["digests"]
            old = [(whole[32 * i: 32 * i + 32], True, a, b, c)
                   for i, (a, b, c) in enumerate(zip(held["ids"], held["n_chars"], held["rows"]))]
        fresh = list(zip(new["digest"].to_pylist(), new["id"].to_pylist(), new["n_chars"].to_pylist(),
                         new["rows"].to_pylist()))
        if held and fresh:
            at = find_slots(_raw(new["digest"]), np.frombuffer(held["moved"], np.int64), len(old))
        else:
            at = np.zeros(len(fresh), np.int64)
        for (digest, who, n, rows), i in zip(fresh, at):
            if held and old[i][0] == digest:
                _, _, other, m, more = old[i]
                if (-n, who is None, who or 0) < (-m, other is None, other or 0):
                    other, m = who, n
                old[i] = (digest, True, other, m, rows + more)
            else:
                out.append((digest, False, who, n, rows))
        columns = list(zip(*(old + out))) or [[]] * 5
        return pa.table(
            {f.name: pa.array(list(c), to_arrow_type(f.dataType)) for f, c in zip(schema.fields, columns)})

    new = incoming.withColumn("bucket", _bucket(buckets))
    return index.groupBy("bucket").cogroup(new.groupBy("bucket")).applyInArrow(merge, schema)


def exact_groups(history: DataFrame, incoming: DataFrame) -> DataFrame:
    """Group id, keep_id, group_size, kept and digest for every row of ``digests`` of both sides.

    Rows with one digest form a group; its row with the most code points, then the
    smallest id, stays. Null and empty texts have the digest of nothing and form one
    group; a null id loses ties; repeated rows (same id and text) are all kept or all
    dropped. Empty sides are fine. Copies are counted before they are shuffled, and
    the rows of a hot digest meet only the one row of their group, in a join whose
    large partitions Spark splits.
    """
    known, new = winners(history), winners(incoming)
    known = checkpoint(known)
    buckets = groups_for(known.count(), BUCKET)
    groups = look_up(build_index(known, buckets), new, buckets).select(
        F.col("digest").alias("group_digest"), F.col("id").alias("keep_id"), F.col("n_chars").alias("keep_chars"),
        F.col("rows").alias("group_size"), "seen",
    )
    rows = history.unionByName(incoming)
    return rows.join(groups, rows["digest"] == groups["group_digest"]).select(
        "id", "keep_id", "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))).alias("kept"),
        "digest", "seen",
    )


def exact_dedup(docs: DataFrame, is_history: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``exact_groups`` of one table of documents; ``is_history`` tells the rows seen before."""
    rows = checkpoint(digests(docs, id_col, text_col, F.coalesce(is_history, F.lit(False)).alias("before")))
    known, new = rows.where("before").drop("before"), rows.where("not before").drop("before")
    return exact_groups(known, new)
