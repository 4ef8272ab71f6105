"""Scalar functions as columns. Lengths and offsets count code points from 0."""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from passagelab.shipping import ship

CHARS_PER_TOKEN = 4
USD_IN, USD_OUT = 3, 15  # per million tokens

#: Words that carry no content.
STOPWORDS = (
    "a an the and or but in on at to for of with "
    "is was are were be been being have has had do does "
    "did will would could should may might shall can need "
    "it its this that these those i you he she we they"
).split()
#: White space as browsers take it: Unicode's, and the byte order mark.
SPACE = r"[\s\p{Z}\x{FEFF}\x{0B}]"


def let(value: Column, function: Callable[[Column], Column]) -> Column:
    """function(value) with the value computed once, however often and within whatever lambdas it is used.

    A column that a lambda merely captures may be inlined by the optimizer and computed again for each element.
    """
    return F.get(F.transform(F.array(value), function), F.lit(0))


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / CHARS_PER_TOKEN).cast("int")


def tokens_to_usd(tokens_in: Column, tokens_out: Column, usd_in: float = USD_IN, usd_out: float = USD_OUT) -> Column:
    return (tokens_in / 1_000_000) * usd_in + (tokens_out / 1_000_000) * usd_out


def trim(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def clip(text: Column, start: Column | int, end: Column | int) -> Column:
    """Characters from start to before end."""
    start, end = (F.lit(x) if isinstance(x, int) else x for x in (start, end))
    return F.substring(text, start + 1, F.greatest(F.lit(0), end - start))


def index_of(text: Column, part: Column, begin: Column | None = None) -> Column:
    """The place of the first `part` not before `begin`; -1 if there is none."""
    return F.call_function("locate", part, text, F.lit(1) if begin is None else begin + 1) - 1


def sentences(text: Column, more_than: int | None = None) -> Column:
    """Parts between white space that follows a full stop, an exclamation or a question mark.

    Without `more_than` they are trimmed and empty ones go; with it they stay as they are if their trimmed length is more.
    """
    parts = F.split(text, rf"(?<=[.!?]){SPACE}+")
    if more_than is None:
        return F.filter(F.transform(parts, trim), lambda s: s != "")
    return F.filter(parts, lambda s: F.length(trim(s)) > more_than)


def lower_words(text: Column) -> Column:
    """Lower-case words between white space; empty ones at the ends stay."""
    return F.split(F.lower(text), rf"{SPACE}+")


def useful(words: Column) -> Column:
    """How many of some lower-case words carry content."""
    return F.size(F.filter(words, lambda w: ~w.isin(STOPWORDS) & (F.length(w) > 1)))


def useful_words(text: Column) -> Column:
    return useful(lower_words(text))


def total_words(text: Column) -> Column:
    return F.size(lower_words(text))


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(trim(text), rf"{SPACE}+"), lambda w: w != ""))


def preview(text: Column, n: int) -> Column:
    return F.concat(F.left(text, F.lit(n)), F.when(F.length(text) > n, F.lit("…")).otherwise(F.lit("")))


def percentile(values: Column, p: float | Column) -> Column:
    """The interpolated percentile of an array; 0 for an empty one."""
    p = p if isinstance(p, Column) else F.lit(float(p))

    def at(v: Column) -> Column:
        spot = p / 100 * (F.size(v) - 1)
        low, high = F.get(v, F.floor(spot).cast("int")), F.get(v, F.ceil(spot).cast("int"))
        return F.when(F.size(v) == 0, F.lit(0.0)).otherwise(low + (high - low) * (spot - F.floor(spot)))

    return let(F.array_sort(values), at)


def upper_median(values: Column, default: float) -> Column:
    """The middle one of the positive values, of two the larger; `default` if there is none."""
    middle = let(F.array_sort(F.filter(values, lambda v: v > 0)), lambda kept: F.get(kept, F.floor(F.size(kept) * 0.5).cast("int")))
    return F.coalesce(middle, F.lit(default))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """The cosine of two arrays of numbers, in doubles; 0 if either has no length. Norms that are known need not be computed for each pair."""
    lengths = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.coalesce(F.try_divide(dot(a, b), F.nullif(lengths, F.lit(0.0))), F.lit(0.0))


def heading_level(ratio: Column) -> Column:
    """The level that a line's height over the body's tells; null for no heading."""
    return F.when(ratio >= 1.8, 1).when(ratio >= 1.4, 2).when(ratio >= 1.15, 3)


def word_bag(text: Column) -> Column:
    """The distinct lower-case words of a text."""
    return F.array_distinct(F.filter(lower_words(text), lambda w: w != ""))


def bag_jaccard(a: Column, b: Column) -> Column:
    """Share of their words that two bags have in common; 0 if neither has one. Each should be bound, see `let`."""
    common = F.size(F.array_intersect(a, b))
    return let(common, lambda both: F.coalesce(F.try_divide(both, F.size(a) + F.size(b) - both), F.lit(0.0)))


def jaccard(a: Column, b: Column) -> Column:
    """Share of the distinct lower-case words that two texts have in common; 0 if neither has one."""
    return let(F.struct(word_bag(a).alias("a"), word_bag(b).alias("b")), lambda x: bag_jaccard(x["a"], x["b"]))


def _fixed_one(value: float | None, digits: int) -> str | None:
    if value is None or value != value:
        return None
    return f"{Decimal(value).quantize(Decimal(1).scaleb(-int(digits)), ROUND_HALF_UP):f}"


def to_fixed(value: Column, digits: int) -> Column:
    """A number with so many digits, rounded from its exact binary value; a reporting function for small tables."""
    ship()

    def run(values: pd.Series) -> pd.Series:
        return pd.Series([_fixed_one(v, digits) for v in values], dtype=object)

    return F.pandas_udf(run, StringType())(value.cast("double"))


def cache_key(strategy: str, config: str, judge: str, text: Column, structure: Column) -> Column:
    """A digest of all that decides a run's result."""
    return F.sha2(F.concat_ws("\u0001", F.lit(strategy), F.lit(config), F.lit(judge), F.to_json(structure), text), 256)


def number_list(text: Column) -> Column:
    """The first JSON array of numbers in a model's answer; null if there is none or it is damaged."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"\[[\d.,\s]+\]", 0), F.lit("")), "array<double>")


def has_number_list(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"\[[\d.,\s]+\]"))


def first_object(text: Column, schema: str) -> Column:
    """The first JSON object (up to the first closing brace)."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"\{[\s\S]*?\}", 0), F.lit("")), schema)


def first_list(text: Column, schema: str) -> Column:
    """The first JSON array up to the first closing bracket."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"\[[\s\S]*?\]", 0), F.lit("")), schema)


def widest_list(text: Column, schema: str) -> Column:
    """A JSON array from the first opening to the last closing bracket."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"\[[\s\S]*\]", 0), F.lit("")), schema)
