"""Quality rules at host level: failure rates shrunk by an empirical beta prior."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import full_text, without_blanks, words
from tracewright.scale import broadcast_if_small, checkpoint

SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class HostRules:
    """Thresholds. A document fails a rule when the rule's ratio is above its limit."""

    min_words: int = 50
    max_repeat_percent: int = 50  # words in repeated three-word windows
    max_symbol_percent: int = 100  # symbols per 100 words
    max_dup_lines_percent: int = 50  # repeated lines per 100 words
    max_mean_word: int = 20  # characters
    host_limit: float = 0.5  # shrunk failure rate of a host above which its documents go


RULES = ("short", "repetitive", "symbols", "dup_lines", "long_words")


def host_of(source: Column) -> Column:
    """Host of an address, in lower case; a source that is no address stands for itself."""
    host = F.regexp_extract(source, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.when(host != "", F.lower(host)).otherwise(source)


def base_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, host and the counts of each whole text; null text: no words."""
    text = full_text(docs[text_col])
    split = docs.select(docs[id_col].alias("id"), host_of(docs[source_col].cast("string")).alias("host"), text.alias("t"))
    split = split.select(
        "id", "host", words(F.col("t")).alias("w"),
        F.char_length(without_blanks(F.col("t"))).cast("long").alias("word_chars"),
        (F.char_length("t") - F.char_length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: without_blanks(x) != "").alias("lines"),
    )
    n = F.size("w")
    inner = F.slice("w", 1, F.greatest(n - 2, F.lit(0)))
    split = split.select(
        "id", "host", "word_chars", "n_symbols", n.cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform(inner, lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))).alias("h"),
    )
    placed = F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    split = split.select(
        *[c for c in split.columns if c != "h"],
        F.when(F.size(F.array_distinct("h")) < F.size("h"), placed).alias("s"),
    )
    twin = lambda x, i: (
        x["h"].eqNullSafe(F.get("s", i - 1)["h"]) | x["h"].eqNullSafe(F.get("s", i + 1)["h"]))
    places = F.transform(F.filter("s", twin), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
    return split.select(
        *[c for c in split.columns if c != "s"],
        F.coalesce(F.size(F.array_distinct(F.flatten(places))), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def rule_failures(f: DataFrame, rules: HostRules) -> dict[str, Column]:
    """Which rules a document fails; whole numbers only."""
    n = f["n_words"]
    return {
        "short": n < rules.min_words,
        "repetitive": 100 * f["n_repeat_words"] > rules.max_repeat_percent * n,
        "symbols": 100 * f["n_symbols"] > rules.max_symbol_percent * n,
        "dup_lines": 100 * f["n_dup_lines"] > rules.max_dup_lines_percent * n,
        "long_words": f["word_chars"] > rules.max_mean_word * n,
    }


def shrunk_rates(hosts: DataFrame) -> DataFrame:
    """Posterior failure rate of each host from its ``docs`` and ``failed``.

    The beta prior comes from all hosts by moments: with mean m and variance v of
    the raw rates, its weight is m(1-m)/v - 1, held within 1 and a million (no
    spread at all: full pooling). The moments are two numbers, whatever the data.
    """
    rate = F.col("failed") / F.col("docs")
    m, v = hosts.agg(F.avg(rate), F.var_pop(rate)).first() or (None, None)
    m, v = m or 0.0, v or 0.0
    weight = 1e6 if v <= 0 else min(1e6, max(1.0, m * (1 - m) / v - 1))
    return hosts.withColumn("rate", (F.col("failed") + F.lit(m * weight)) / (F.col("docs") + F.lit(weight)))


def host_rules(
    docs: DataFrame, rules: HostRules = HostRules(), id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: id, host, counts, base_failed, host_rate, host_kept, kept.

    A document fails when it fails any rule; a host's failures are summed (map-side
    first, so a hot host is cheap), its rate is shrunk, and the verdict is joined
    back on the host. Base failures (short or repetitive) go by themselves. Null
    texts have no words and fail as short; documents without a source form one host.
    Repeated rows count as rows. An empty table gives an empty result. The join
    broadcasts hosts only when they are measured to be few, else Spark shuffles it
    and splits hot hosts.
    """
    f = checkpoint(base_features(docs, id_col, text_col, source_col))
    failures = rule_failures(f, rules)
    any_failed = failures["short"]
    for name in RULES[1:]:
        any_failed = any_failed | failures[name]
    hosts = checkpoint(f.groupBy("host").agg(
        F.count("*").alias("docs"), F.sum(any_failed.cast("long")).alias("failed"),
        *[F.sum(c.cast("long")).alias(f"failed_{k}") for k, c in failures.items()],
    ))
    verdicts = shrunk_rates(hosts).select(F.col("host").alias("h"), F.col("rate").alias("host_rate"))
    verdicts = broadcast_if_small(verdicts)
    joined = f.join(verdicts, f["host"].eqNullSafe(verdicts["h"]))
    base = failures["short"] | failures["repetitive"]
    good = F.col("host_rate") <= rules.host_limit
    return joined.select(
        *f.columns, base.alias("base_failed"), "host_rate", good.alias("host_kept"), (~base & good).alias("kept"),
    )
