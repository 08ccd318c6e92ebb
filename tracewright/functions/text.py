"""Text normalisation as Column expressions (no Python in the hot path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.structs import let

# Blanks in the Unicode sense, listed: faster than a Unicode class, and complete.
_OTHER_BLANKS = (
    r"\t\n\x0b\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)
BLANK = f"[ {_OTHER_BLANKS}]"
_LOOSE = rf"[{_OTHER_BLANKS}]|  |^ | $"
_NOT_COMPACT = _LOOSE + r"| [,.;:]"


def strip(col: Column) -> Column:
    """Cut Unicode blanks at both ends (``trim`` would cut only U+0020)."""
    return F.regexp_replace(col, rf"^{BLANK}+|{BLANK}+$", "")


def collapse(col: Column) -> Column:
    """Every run of blanks becomes one space; none stays at the ends."""
    return F.when(
        F.rlike(col, F.lit(_LOOSE)), F.trim(F.regexp_replace(col, BLANK + "+", " "))
    ).otherwise(col)


def compact_text(col: Column) -> Column:
    """``collapse``, then no space before ``, . ; :``.

    Most texts are compact already; they are only looked at.
    """
    compacted = F.regexp_replace(
        F.trim(F.regexp_replace(col, BLANK + "+", " ")), r" +([,.;:])", "$1"
    )
    return F.when(F.rlike(col, F.lit(_NOT_COMPACT)), compacted).otherwise(col)


def norm_text(col: Column) -> Column:
    """Comparison form of an activity name: collapsed, lower case, null -> ''."""
    return F.lower(collapse(F.coalesce(col.cast("string"), F.lit(""))))


def norm_key(col: Column) -> Column:
    """Lookup form of a raw activity name: collapsed, case kept, null -> ''."""
    return collapse(F.coalesce(col.cast("string"), F.lit("")))


def alnum_token(col: Column) -> Column:
    """Lower case letters a-z and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(col.cast("string"), F.lit(""))), "[^a-z0-9]+", "")


def value_text(df: DataFrame, name: str) -> Column:
    """Readable text of an attribute, typed by the column of ``df``.

    Null and blank give null; booleans and their spellings give yes/no; whole
    floats print as integers, others with up to two decimals.
    """
    return value_text_of(F.col(quoted(name)), df.schema[name].dataType)


def value_text_of(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BooleanType):
        return F.when(col, "yes").when(~col, "no")
    if isinstance(dtype, T.IntegralType):
        return col.cast("string")
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        x = col.cast("double")
        # format_number('0.##') rounds the binary value half-even and drops
        # trailing zeros; format_string would round 2.675 up.
        return (
            F.when(x.isNull() | F.isnan(x), None)
            .when(F.abs(x) < 1e-9, "0")
            .otherwise(F.call_function("format_number", x, F.lit("0.##")))
        )
    # Spellings of yes and no.
    text = col.cast("string")
    return (
        F.when(F.rlike(text, F.lit(f"^{BLANK}*$")), None)
        .when(F.rlike(text, F.lit(f"(?i)^{BLANK}*(?:true|yes){BLANK}*$")), "yes")
        .when(F.rlike(text, F.lit(f"(?i)^{BLANK}*(?:false|no){BLANK}*$")), "no")
        .otherwise(strip(text))
    )


def join_phrases(phrases: list[Column]) -> Column:
    """'a', 'a and b', 'a, b, and c'; blanks and nulls dropped; '' for none."""
    kept = [F.nullif(compact_text(p), F.lit("")) for p in phrases]
    if len(kept) < 3:
        return F.concat_ws(" and ", *kept)

    def told(text: Column) -> Column:
        last = F.substring_index(text, "\x01", -1)
        rest = F.substring(text, F.lit(1), F.length(text) - F.length(last) - 1)
        several = F.concat(F.replace(rest, F.lit("\x01"), F.lit(", ")), F.lit(", and "), last)
        return F.when(F.contains(rest, F.lit("\x01")), several).otherwise(
            F.replace(text, F.lit("\x01"), F.lit(" and "))
        )

    return let(F.concat_ws("\x01", *kept), told)


def end_sentence(col: Column) -> Column:
    """Compacted text with a final period unless it ends with . ! or ?"""
    return F.regexp_replace(compact_text(col), r"([^.!?])$", "$1.")


def end_compact(col: Column) -> Column:
    """``end_sentence`` of joined compact parts: only the joints can be loose."""
    joints = [F.contains(col, F.lit(x)) for x in ("  ", " ,", " .", " ;", " :")]
    loose = joints[0] | joints[1] | joints[2] | joints[3] | joints[4]
    ended = F.endswith(col, F.lit(".")) | F.endswith(col, F.lit("!")) | F.endswith(col, F.lit("?"))
    return F.when(loose, end_sentence(col)).when(ended, col).otherwise(F.concat(col, F.lit(".")))


def floor_days(col: Column) -> Column:
    """Whole days, never negative, null -> 0."""
    return F.floor(F.greatest(F.coalesce(col.cast("double"), F.lit(0.0)), F.lit(0.0)))


def read_flag(col: Column, dtype: T.DataType) -> Column:
    """Nullable boolean reading of a cell; numbers truncate towards zero."""
    if isinstance(dtype, T.BooleanType):
        return col
    if isinstance(dtype, T.NumericType):
        x = col.cast("double")
        return F.when(x.isNull() | F.isnan(x), None).otherwise(F.abs(x) >= 1)
    low = F.lower(strip(col.cast("string")))
    # Spellings of true and false.
    return F.when(
        low.isin("1", "true", "t", "yes", "y", "closed", "complete", "completed"), True
    ).when(low.isin("0", "false", "f", "no", "n", "open", "incomplete"), False)


def label_word(col: Column, positive: str = "success", negative: str = "failure") -> Column:
    """Known spellings of an outcome to the label pair; anything else to null."""
    low = F.lower(strip(col.cast("string")))
    # Spellings of the two outcomes.
    return F.when(
        low.isin("succeed", "success", "successful", "1", "true", "yes"), positive
    ).when(low.isin("failure", "fail", "failed", "0", "false", "no"), negative)


def json_list(items: Column) -> Column:
    """JSON text of a string array, with a blank after each comma."""
    def one(x: Column) -> Column:
        text = F.to_json(F.array(x))
        plain = F.rlike(x, F.lit(r'^[ !#-\[\]-~]*\z'))  # nothing to escape: no JSON writer is made for it
        return F.when(plain, F.concat(F.lit('"'), x, F.lit('"'))).otherwise(F.substring(text, F.lit(2), F.length(text) - 2))

    return F.concat(F.lit("["), F.array_join(F.transform(items, one), ", "), F.lit("]"))


def hash_order(seed: int, purpose: str, *cols: Column) -> Column:
    """Reproducible random order: md5 hex of seed, purpose and the row's key.

    Independent of partitioning, visit order and engine.
    """
    parts = [F.lit(str(seed)), F.lit(purpose)] + [c.cast("string") for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def quoted(name: str) -> str:
    """Back-ticked column name; event-log attributes contain ':' and '.'."""
    return "`" + name.replace("`", "``") + "`"
