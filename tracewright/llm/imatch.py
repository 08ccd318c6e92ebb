"""I-Match fingerprints: hashes of a document's terms from randomised parts of a lexicon.

The lexicon holds the terms of a band of inverse document frequency. Each of its
parts takes a term by a hash of (part, term) against the part's rate; rates fall from
a half to a thousandth, so that a short and a long document both have parts with a few
of their terms. For each part a document's distinct terms are sorted and hashed.
DataFrame functions only.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType
from pyspark.sql.window import Window as W

from tracewright.llm.common import full_text
from tracewright.scale import broadcast_if_small, checkpoint

# The band: terms that at least one document in RAREST holds, and at most one in COMMONEST; idf is ln of these.
RAREST, COMMONEST = 1_000, 10
RATES = (2, 2, 4, 4, 8, 8, 16, 16) + (32,) * 4 + (64,) * 4 + (128,) * 4 + (256,) * 4 + (512,) * 4 + (1024,) * 4
NONE = "-" * 8  # stands for a part of which the document has no term
NOT_TERM = r"[^\p{L}\p{M}\p{N}]+"
# The band has RAREST times the mean number of distinct terms at most, whatever the corpus; a term is in 2.1 parts on average.
LEXICON_ROWS, LEXICON_BYTES = 2_000_000, 64 << 20
BLOCK_BYTES = 8 << 20  # of text that is sorted together by id, on average
MAX_BLOCKS, FAN = 1 << 16, 256  # borders on the driver, at most, and how many a search looks at


def terms(text: Column) -> Column:
    """Distinct runs of letters, marks and digits of a whole text in lower case; the empty one too."""
    return F.array_distinct(F.concat(F.split(F.lower(text), NOT_TERM), F.array(F.lit(""))))


def lexicon(docs: DataFrame, total: int, text_col: str = "text") -> DataFrame:
    """(term, part) for every part that a term of the band is in; the empty term with part -1 is always there.

    Document frequencies are counted over all documents, combined before the shuffle.
    """
    each = docs.select(F.explode(terms(full_text(docs[text_col]))).alias("term")).where("term <> ''")
    counts = each.groupBy("term").agg(F.count("*").alias("df"))
    band = counts.where((F.col("df") * RAREST >= total) & (F.col("df") * COMMONEST <= total))
    parts = F.array(*[F.struct(F.lit(j).alias("j"), F.lit((1 << 32) // r).alias("below")) for j, r in enumerate(RATES)])

    def takes(part: Column) -> Column:
        draw = F.md5(F.concat(part["j"].cast("string"), F.lit(":"), F.col("term")).cast("binary"))
        return F.conv(F.substring(draw, 1, 8), 16, 10).cast("long") < part["below"]

    taken = band.select("term", F.explode(F.filter(parts, takes)).alias("part")).select("term", F.col("part.j").alias("part"))
    return taken.unionByName(docs.sparkSession.createDataFrame([("", -1)], "term string, part int"))


def signature(hashes: Column, first: int, whole: Column) -> Column:
    """One string for the parts from number ``first`` on, from a map of their hashes.

    A text without a term in any part gets ``whole``, the hash of the text, in every place.
    """
    places = F.transform(F.sequence(F.lit(first), F.lit(first + len(RATES) - 1)), lambda j: F.try_element_at(hashes, j))
    none = F.forall(places, lambda h: h.isNull())
    return F.when(none, F.repeat(whole, len(RATES))).otherwise(F.array_join(places, "", NONE))


def whole_hash(text: Column) -> Column:
    return F.when(text == "", NONE).otherwise(F.substring(F.md5(F.concat(F.lit("whole "), text).cast("binary")), 1, 8))


def likeness(a: Column, b: Column) -> Column:
    """Parts with one hash in both, by parts in which either has a term; equal fingerprints are 1."""
    places = F.sequence(F.lit(1), F.lit(8 * len(RATES)), F.lit(8))

    def verdict(i: Column) -> Column:
        x, y = F.substr(a, i, F.lit(8)), F.substr(b, i, F.lit(8))
        return F.when(x != y, 0).when(x != NONE, 1)

    both = F.transform(places, verdict)
    told = F.filter(both, lambda x: x.isNotNull())
    agree = F.aggregate(told, F.lit(0), lambda n, x: n + x)
    return F.when(a == b, 1.0).otherwise(agree / F.size(told)).cast("double")


def edited(text: Column, after: Column) -> Column:
    """``text``, its last half (rounded down) replaced by as many characters from the start of ``after``."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - half), F.substr(after, F.lit(1), half))


def _borders(keys: DataFrame, blocks: int) -> list[dict]:
    """The least key of each of about ``blocks`` equal ranges; one small row each."""
    part = keys.repartitionByRange(blocks, *keys.columns).withColumn("part", F.spark_partition_id())
    least = part.groupBy("part").agg(F.min(F.struct(*keys.columns)).alias("k"))
    return [json.loads(r[0]) for r in least.select(F.to_json("k", {"ignoreNullFields": "false"}), "part").orderBy("part").collect()]


def _block(key: Column, kind: StructType, borders: list[dict]) -> Column:
    """Number of the last border that is not above ``key``: first among every ``FAN``-th, then in between."""
    nested = [borders[i: i + FAN] for i in range(0, len(borders), FAN)]
    top = F.from_json(F.lit(json.dumps([g[0] for g in nested])), ArrayType(kind))
    groups = F.from_json(F.lit(json.dumps(nested)), ArrayType(ArrayType(kind)))

    def place(among: Column) -> Column:
        return F.greatest(F.size(F.filter(among, lambda b: b <= key)), F.lit(1))

    i = place(top)
    return ((i - 1) * FAN + place(F.element_at(groups, i)) - 1).cast("int")


def _told(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Fingerprints of ``text`` and of ``edited`` (null: none) for rows in order within their block.

    Terms meet the broadcast lexicon one by one and are gathered again in the same
    task, as the rows of a block are already together; no text is moved.
    """
    def side(number: int, text: str) -> Column:
        return F.transform(terms(F.col(text)), lambda t: F.struct(F.lit(number).alias("side"), t.alias("term")))

    flat = rows.select(
        "block", "id", "h", F.char_length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        whole_hash(F.col("text")).alias("own_hash"), whole_hash(F.col("edited")).alias("other_hash"),
        F.monotonically_increasing_id().alias("row"), F.concat(side(0, "text"), F.coalesce(side(1, "edited"), F.array())).alias("all"))
    flat = flat.select("*", F.explode("all").alias("t"))
    hashed = F.when(F.col("t.side") == 0, F.col("own_hash")).otherwise(F.col("other_hash"))
    more = F.when(F.col("t.term") == "", F.struct("id", "h", "n_chars", "edited_sha256", hashed.alias("whole")))
    flat = flat.select("block", "row", "t.side", "t.term", more.alias("more"))
    met = flat.join(known, "term")
    each = met.groupBy("block", "row", "side", "part").agg(F.max("more").alias("more"), F.collect_list("term").alias("terms"))
    digest = F.substring(F.md5(F.array_join(F.sort_array("terms"), " ").cast("binary")), 1, 8)
    place = F.col("side") * len(RATES) + F.col("part")
    hashed = each.select("block", "row", "side", "more", F.when(F.col("part") >= 0, F.struct(place.alias("key"), digest.alias("value"))).alias("entry"))
    both = hashed.groupBy("block", "row").agg(
        F.max(F.when(F.col("side") == 0, F.col("more"))).alias("own"), F.max(F.when(F.col("side") == 1, F.col("more"))).alias("other"),
        F.map_from_entries(F.collect_list("entry")).alias("hashes"))
    hashes = F.col("hashes")
    return both.select(
        "block", "row", "own.id", "own.h", "own.n_chars", "other.edited_sha256",
        signature(hashes, 0, F.col("own.whole")).alias("fingerprint"),
        F.when(F.col("other").isNotNull(), signature(hashes, len(RATES), F.col("other.whole"))).alias("edited_fingerprint"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every whole text and of its edited text, and how like it is to that and to the next.

    Columns: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. The next document is that of the next id (null first; equal ids by a
    hash of the text; repeated rows follow each other), after the last the first.
    Null texts are empty; an empty text has no term and equals only another without
    any. A lone document is its own next. An empty table gives an empty result.

    A row's place needs no task that sees all rows: rows go once, by ranges of
    (id, text hash, salt), to blocks that are sorted apiece, so one id may have any
    number of rows. The last document of a block and the first of the next one meet
    afterwards; there are as many such pairs as blocks, ``MAX_BLOCKS`` at most.
    """
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(4_096)).cast("int")
    text = full_text(docs[text_col])
    rows = docs.select(docs[id_col].alias("id"), text.alias("text"), F.xxhash64(text).alias("h"), salt.alias("s"))
    total, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    known = checkpoint(lexicon(docs, total, text_col))
    known = broadcast_if_small(known, LEXICON_ROWS, LEXICON_BYTES)

    order = ["id", "h", "s"]
    keys = rows.select(*order)
    borders = _borders(keys, max(1, min(MAX_BLOCKS, size // BLOCK_BYTES)))
    placed = rows.withColumn("block", _block(F.struct(*order), keys.schema, borders) if borders else F.lit(0))
    by_id = W.partitionBy("block").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    placed = placed.withColumn("after", F.lead("text").over(by_id))
    told = _told(placed.withColumn("edited", edited(F.col("text"), F.col("after"))), known)
    in_block = W.partitionBy("block").orderBy("row")
    core = checkpoint(told.withColumn("next_fingerprint", F.lead("fingerprint").over(in_block)))

    ends = core.groupBy("block").agg(F.max("row").alias("row"), F.min_by(F.struct("id", "h", "fingerprint"), "row").alias("first"),
                                     F.max_by(F.struct("id", "h"), "row").alias("last"))
    around = W.partitionBy(F.lit(0)).orderBy("block")  # one row a block
    start = F.first("first").over(around.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    ends = checkpoint(ends.select("block", "row", "last", F.coalesce(F.lead("first").over(around), start).alias("then")))
    wanted = ends.select(F.explode(F.array("last", F.struct("then.id", "then.h"))).alias("k")).select("k.*").distinct()
    wanted = F.broadcast(wanted.select(F.col("id").alias("want_id"), F.col("h").alias("want_h")))  # two a block at most
    texts = rows.join(wanted, rows["id"].eqNullSafe(F.col("want_id")) & (rows["h"] == F.col("want_h")), "left_semi")
    texts = checkpoint(texts.groupBy("id", "h").agg(F.first("text").alias("text")))
    a, b = (texts.select(F.col("id").alias(f"{x}_id"), F.col("h").alias(f"{x}_h"), F.col("text").alias(f"{x}_text")) for x in "ab")
    pairs = ends.join(a, F.col("last.id").eqNullSafe(F.col("a_id")) & (F.col("last.h") == F.col("a_h")))
    pairs = pairs.join(b, F.col("then.id").eqNullSafe(F.col("b_id")) & (F.col("then.h") == F.col("b_h")))
    pairs = pairs.select("block", "a_id", "a_h", F.col("a_text").alias("text"), edited(F.col("a_text"), F.col("b_text")).alias("edited"))
    mended = _told(pairs.withColumnsRenamed({"a_id": "id", "a_h": "h"}), known)
    mended = mended.select("block", F.col("edited_sha256").alias("sha"), F.col("edited_fingerprint").alias("print"))
    mended = F.broadcast(checkpoint(mended.join(ends.select("block", F.col("row").alias("last_row"), F.col("then.fingerprint").alias("then_print")), "block")))

    whole = core.join(mended, (core["block"] == mended["block"]) & (core["row"] == mended["last_row"]), "left")
    own, other = F.col("fingerprint"), F.coalesce("edited_fingerprint", "print")
    out = whole.select("id", "n_chars", F.coalesce("edited_sha256", "sha").alias("edited_sha256"), "fingerprint",
                       other.alias("edited_fingerprint"), F.coalesce("next_fingerprint", "then_print").alias("next"))
    return out.select("id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                      likeness(own, F.col("edited_fingerprint")).alias("near_edited"), likeness(own, F.col("next")).alias("near_next"))
