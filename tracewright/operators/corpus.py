"""Text corpora: cleaning, token counts, length limits and response masks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.prompts import RESPONSE
from tracewright.functions.text import strip
from tracewright.operators.sampling import random_rows

IGNORED = -100  # fixed value: label of positions without loss
ENCODED_AT_ONCE = 1 << 20  # characters


def clean_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Text stripped, null as '', empty rows dropped."""
    if text not in df.columns:
        raise KeyError(f"no text column {text} among {df.columns}")
    cleaned = strip(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return df.withColumn(text, cleaned).where(F.length(text) > 0)


def append_end(text: Column, marker: str | None, only_if_missing: bool = False) -> Column:
    """Text with the end marker."""
    if not marker:
        return text
    marked = F.concat(text, F.lit(marker))
    return F.when(F.endswith(text, F.lit(marker)), text).otherwise(marked) if only_if_missing else marked


def word_tokens(text: Column) -> Column:
    """Default tokeniser: words and single other marks."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\w+|[^\w\s]"), F.lit(0))


def word_ids(text: Column) -> Column:
    """Token ids of the default tokeniser: a 31-bit hash of the token."""
    return F.transform(word_tokens(text), lambda t: F.pmod(F.hash(t), F.lit(2**31 - 1)))


def batch_tokenizer(encode: Callable[[list[str]], list[list[int]]]) -> Callable[[Column], Column]:
    """A tokeniser of text batches as a Column function, in Arrow batches.

    ``encode`` gets ``ENCODED_AT_ONCE`` characters at once at most, or one longer text,
    and its lists are packed before the next, so a worker never holds a whole batch as numbers of Python.
    """
    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        out: list[np.ndarray | None] = []
        part: list[str] = []
        size = 0

        def packed() -> list[np.ndarray | None]:
            return [None if x is None else np.asarray(x, np.int32) for x in encode(part)] if part else []

        for text in texts:
            if part and size + len(text or "") > ENCODED_AT_ONCE:
                out += packed()
                part, size = [], 0
            part.append(text)
            size += len(text or "")
        return pd.Series(out + packed(), dtype=object)

    return ids


def token_counts(
    df: DataFrame, text: str = "text", tokenizer: Callable[[Column], Column] = word_tokens,
    out: str = "n_tokens",
) -> DataFrame:
    return df.withColumn(out, F.size(tokenizer(F.col(text))))


def drop_overlong(
    df: DataFrame, max_length: int, text: str = "text",
    tokenizer: Callable[[Column], Column] = word_tokens,
) -> DataFrame:
    """Rows with fewer than ``max_length`` tokens."""
    return df.where(F.size(tokenizer(F.col(text))) < max_length)


def overlong_report(
    df: DataFrame, max_length: int, text: str = "text",
    tokenizer: Callable[[Column], Column] = word_tokens,
) -> DataFrame:
    """One row: rows before, dropped rows, dropped share."""
    long = F.size(tokenizer(F.col(text))) >= max_length
    return df.agg(F.count("*").alias("n_before"), F.count_if(long).alias("n_dropped")).withColumn(
        "dropped_share", F.col("n_dropped") / F.greatest(F.col("n_before"), F.lit(1))
    )


def length_profile(
    df: DataFrame, n: int, seed: int, key: Sequence[str], text: str = "text",
    tokenizer: Callable[[Column], Column] = word_tokens,
) -> DataFrame:
    """Token lengths of n random rows: count, min, percentiles, max, mean.

    Only keys and lengths are ranked, not the texts.
    """
    lengths = df.select(*key, F.size(tokenizer(F.col(text))).alias("len"))
    sample = random_rows(lengths, n, seed, key)

    def at(q: float) -> Column:
        return F.round(F.percentile("len", F.lit(q)), 6).cast("long")

    return sample.agg(
        F.count("*").alias("count"), F.min("len").alias("min"),
        *[at(q).alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.95, 0.99)],
        F.max("len").alias("max"), F.avg("len").alias("mean"),
    )


def length_quantiles(
    df: DataFrame, keys: Sequence[str], ranks: Sequence[float] = (0.5, 0.9, 0.95, 0.99), text: str = "text",
    tokenizer: Callable[[Column], Column] = word_tokens, k: int = 400,
) -> DataFrame:
    """``keys, n_rows, rank, length``: quantiles of the token lengths of all rows of each group.

    A KLL sketch per group, merged from partial ones, so no group is sorted or held. The
    rank of a returned length is off by less than one percent of the rows at the default
    ``k`` (with about 99 % certainty, and exact for groups smaller than ``k``). A text
    that is null has no length.
    """
    lengths = df.select(*keys, F.size(tokenizer(F.col(text))).cast("long").alias("len")).where(F.col(text).isNotNull())
    sketches = lengths.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.kll_sketch_agg_bigint("len", k).alias("sketch"))
    points = F.array(*[F.struct(F.lit(float(r)).alias("rank"), F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(r))).alias("length")) for r in ranks])
    return sketches.select(*keys, "n_rows", F.inline(points))


def split_response(
    df: DataFrame, text: str = "text", marker: str = RESPONSE, end: str | None = None
) -> DataFrame:
    """``prompt`` up to and with the last marker, ``response`` after it; error without one."""
    full = append_end(strip(F.col(text)), end, only_if_missing=True)
    response = F.substring_index(full, marker, -1)
    found = F.contains(full, F.lit(marker))
    prompt = F.when(
        found, F.substring(full, F.lit(1), F.length(full) - F.length(response))
    ).otherwise(F.raise_error(F.concat(
        F.lit("no response marker in sample: "), F.substring(full, 1, 300)
    )).cast("string"))
    return df.withColumns({"full_text": full, "prompt": prompt, "response": response})


def mask_prompt(
    df: DataFrame, max_length: int, text: str = "text", marker: str = RESPONSE,
    end: str | None = None, tokenizer: Callable[[Column], Column] = word_ids,
    responses_only: bool = True,
) -> DataFrame:
    """``input_ids, attention_mask, labels, loss_tokens``; samples without loss are dropped.

    Overlong samples keep their right end; prompt positions left are masked.
    """
    rows = split_response(df, text, marker, end).withColumns({
        "_ids": tokenizer(F.col("full_text")), "_prompt_ids": tokenizer(F.col("prompt")),
    })
    n = F.size("_ids")
    kept = F.least(n, F.lit(max_length))
    ids = F.when(kept > 0, F.slice("_ids", n - kept + 1, kept)).otherwise(
        F.slice("_ids", 1, 0))
    masked = F.greatest(F.least(F.size("_prompt_ids"), n) - (n - kept), F.lit(0))
    labels = F.concat(
        F.array_repeat(F.lit(IGNORED), masked),
        F.slice(F.col("input_ids"), masked + 1, F.size("input_ids") - masked),
    ) if responses_only else F.col("input_ids")
    return (
        rows.withColumn("input_ids", ids)
        .withColumns({
            "attention_mask": F.transform("input_ids", lambda _: F.lit(1)),
            "labels": labels,
            "loss_tokens": F.size("input_ids") - (masked if responses_only else F.lit(0)),
        })
        .where("loss_tokens > 0").drop("_ids", "_prompt_ids")
    )
