"""Row-local table functions: how a text becomes an array of pieces. No shuffle, and no Python but to look for pieces in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice
from math import ceil, floor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagelab.functions.text import clip, estimate_tokens, index_of, let, trim
from passagelab.shipping import ship

SEPARATORS = (("\n\n", "\n\n"), (". ", r"\. "), (" ", " "))
PACKED = "struct<done: array<string>, open: string>"


def _pack(text: Column, most: int, level: int, true_recursive: bool) -> Column:
    """Pieces of a text that is too long: parts at this level's separator, packed greedily up to `most` characters."""
    separator, pattern = SEPARATORS[level]

    def step(state: Column, part: Column) -> Column:
        joined = F.when(state["open"] == "", part).otherwise(F.concat(state["open"], F.lit(separator), part))
        closed = F.when(state["open"] == "", state["done"]).otherwise(F.concat(state["done"], F.array(state["open"])))
        if level + 1 == len(SEPARATORS):
            flushed = F.struct(closed.alias("done"), part.alias("open"))
        elif true_recursive:
            flushed = F.when(F.length(part) > most, F.struct(F.concat(closed, _pack(part, most, level + 1, True)).alias("done"), F.lit("").alias("open"))).otherwise(F.struct(closed.alias("done"), part.alias("open")))
        else:
            inner = F.when(F.length(part) > most, F.array_join(_pack(part, most, level + 1, False), "")).otherwise(part)
            flushed = F.struct(closed.alias("done"), inner.alias("open"))
        return F.when(F.length(joined) <= most, F.struct(state["done"].alias("done"), joined.alias("open"))).otherwise(flushed)

    begin = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    end = lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))
    return F.aggregate(F.split(text, pattern), begin, step, end)


def recursive_split(text: Column, most: int, true_recursive: bool = False) -> Column:
    """Pieces of about `most` characters. Inner pieces are joined again without their separators, as in the engine's model, so a piece
    may be longer; with true_recursive they stay apart."""
    return F.when(F.length(text) <= most, F.array(text)).otherwise(_pack(text, most, 0, true_recursive))


def check_step(size: int, overlap: int) -> None:
    if size <= overlap:
        raise ValueError(f"the overlap ({overlap}) must be smaller than the window ({size})")


def window_starts(text: Column, size: int, overlap: int) -> Column:
    """Starts of windows of `size` characters that overlap; the last is the first to reach the end."""
    check_step(size, overlap)
    step, n = size - overlap, F.length(text)
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step)).cast("int")
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), last), lambda k: k * step))


def child_starts(text: Column, size: int, overlap: int) -> Column:
    """Starts of a parent's children: as far as whole windows fit, and then one shorter tail."""
    check_step(size, overlap)
    step, n = size - overlap, F.length(text)
    k = F.greatest(F.lit(1), (F.floor((n - size) / step) + 1).cast("int"))
    last = F.when(k * step < n, k).otherwise(k - 1)
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: i * step))


def pairs_of(items: Column) -> Column:
    """Neighbours (a, b); none for fewer than two items."""

    def zipped(v: Column) -> Column:
        n = F.greatest(F.lit(0), F.size(v) - 1)
        return F.zip_with(F.slice(v, 1, n), F.slice(v, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))

    return let(items, zipped)


def _places(items: Column) -> Column:
    return F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(F.array().cast("array<int>"))


def merge_pairs(items: Column, scores: Column, threshold: float) -> Column:
    """Joins items i and i+1 by a space from left to right where score i reaches the threshold; an item is joined once.

    In a run of such scores every other one joins. Missing scores join nothing and surplus ones are ignored.
    """

    def fold(v: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            own, following = F.get(v["items"], i), F.get(v["items"], i + 1)
            joins = F.coalesce(F.get(v["scores"], i) >= threshold, F.lit(False)) & (i + 1 < F.size(v["items"]))
            done = F.when(state["skip"], state["done"]).when(joins, F.concat(state["done"], F.array(F.concat(own, F.lit(" "), following)))).otherwise(F.concat(state["done"], F.array(own)))
            return F.struct(done.alias("done"), (~state["skip"] & joins).alias("skip"))

        begin = F.struct(F.array().cast("array<string>").alias("done"), F.lit(False).alias("skip"))
        return F.aggregate(_places(v["items"]), begin, step, lambda s: s["done"])

    return let(F.struct(items.alias("items"), scores.alias("scores")), fold)


def merge_small(items: Column, least_tokens: int) -> Column:
    """Joins runs of neighbouring items under `least_tokens` by a space; larger items stay alone."""

    def step(state: Column, item: Column) -> Column:
        is_small = estimate_tokens(item) < least_tokens
        grown = F.when(state["open"] == "", item).otherwise(F.concat(state["open"], F.lit(" "), item))
        closed = F.when(state["open"] == "", state["done"]).otherwise(F.concat(state["done"], F.array(state["open"])))
        return F.when(is_small, F.struct(state["done"].alias("done"), grown.alias("open"))).otherwise(F.struct(F.concat(closed, F.array(item)).alias("done"), F.lit("").alias("open")))

    begin = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    end = lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))
    return F.aggregate(items, begin, step, end)


def group_at(items: Column, boundaries: Column, least: int) -> Column:
    """Items joined by spaces, in groups that close at a boundary (true after an item) once they have `least` items.

    A last group that is too small goes to the one before it.
    """

    def fold(v: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            grown = F.when(state["n"] == 0, F.get(v["items"], i)).otherwise(F.concat(state["open"], F.lit(" "), F.get(v["items"], i)))
            closes = F.coalesce(F.get(v["bounds"], i), F.lit(False)) & (state["n"] + 1 >= least)
            return F.when(closes, F.struct(F.concat(state["done"], F.array(grown)).alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))).otherwise(
                F.struct(state["done"].alias("done"), grown.alias("open"), (state["n"] + 1).alias("n"))
            )

        def end(s: Column) -> Column:
            count = F.size(s["done"])
            back = F.concat(F.slice(s["done"], 1, F.greatest(F.lit(0), count - 1)), F.array(F.concat(F.get(s["done"], count - 1), F.lit(" "), s["open"])))
            return F.when(s["n"] == 0, s["done"]).when((count > 0) & (s["n"] < least), back).otherwise(F.concat(s["done"], F.array(s["open"])))

        begin = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("n"))
        return F.aggregate(_places(v["items"]), begin, step, end)

    return let(F.struct(items.alias("items"), boundaries.alias("bounds")), fold)


PLACE = "array<struct<text: string, start: int, end: int, located: boolean>>"


def place(text: Column, pieces: Column) -> Column:
    """Where each piece stands first; one that is not in the text is put at 0."""

    def one(whole: Column, piece: Column) -> Column:
        at = index_of(whole, piece)
        start = F.greatest(at, F.lit(0))
        return F.struct(piece.alias("text"), start.cast("int").alias("start"), (start + F.length(piece)).cast("int").alias("end"), (at >= 0).alias("located"))

    return let(F.struct(text.alias("t"), pieces.alias("p")), lambda v: F.transform(v["p"], lambda piece: one(v["t"], piece)))


def _searched(texts: pa.Array, pieces: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array, Callable[[pa.Array], pa.Array]]:
    """(pieces in one array, starts, ends, whether found, a function that makes lists of such an array again) of pieces that are looked for one after the other."""
    sizes = pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False)
    flat = pieces.flatten()
    waiting, starts, ends, found = iter(flat.to_pylist()), [], [], []
    for text, n in zip(texts.to_pylist(), sizes.tolist()):
        cursor = 0
        for piece in islice(waiting, n):
            if text is None or piece is None:
                at = None
            else:
                at = text.find(piece, cursor) if piece else 0
            start = cursor if at is None or at < 0 else at
            end = None if piece is None else start + len(piece)
            starts.append(start)
            ends.append(end)
            found.append(None if at is None else at >= 0)
            cursor = start if end is None else end
    offsets, mask = pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pieces.is_null()
    return flat.cast(pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(found, pa.bool_()), lambda values: pa.ListArray.from_arrays(offsets, values, mask=mask)


def _placed(texts: pa.Array, pieces: pa.Array) -> pa.Array:
    own, starts, ends, found, listed = _searched(texts, pieces)
    return listed(pa.StructArray.from_arrays([own, starts, ends, found], ["text", "start", "end", "located"]))


def place_in_order(text: Column, pieces: Column) -> Column:
    """Where each piece stands after the one before; one that is not found there is put right after it.

    In Python, where a search begins at its place at once: expressions count the characters of a long text from its beginning for each piece.
    """
    ship()
    return F.arrow_udf(_placed, PLACE)(text, pieces)


def _groups(items: list[str] | None, drops: list[float | None] | None, percentile: float, least: int) -> list[str] | None:
    """The groups of group_at, which close where a drop reaches the percentile of all (see text.percentile)."""
    if items is None:
        return None
    drops = drops or []
    order = sorted(drops, key=lambda d: (d is None, d or 0.0))
    limit: float | None = 0.0
    if order:
        spot = percentile / 100 * (len(order) - 1)
        low, high = order[floor(spot)], order[ceil(spot)]
        limit = None if low is None or high is None else low + (high - low) * (spot - floor(spot))
    done, waiting = [], []
    for k, item in enumerate(items):
        waiting.append(item)
        if k < len(drops) and limit is not None and drops[k] is not None and drops[k] >= limit and len(waiting) >= least:
            done.append(" ".join(waiting))
            waiting = []
    if waiting and done and len(waiting) < least:
        done[-1] = " ".join([done[-1], *waiting])
    elif waiting:
        done.append(" ".join(waiting))
    return done


def with_placed_groups(df: DataFrame, out: str, text: str, items: str, drops: str, percentile: float, least: int) -> DataFrame:
    """df with place_in_order of the groups of items that the largest drops between neighbours divide.

    A pass of its own: Spark 4.1 fails on a function in Python of which an argument has lambdas in lambdas that capture something.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                groups = [_groups(i, d, float(percentile), least) for i, d in zip(batch.column(items).to_pylist(), batch.column(drops).to_pylist())]
                placed = _placed(batch.column(text), pa.array(groups, pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays([*batch.columns, placed], [*batch.schema.names, out])

    return df.mapInArrow(run, df.withColumn(out, F.lit(None).cast(PLACE)).schema)


def contained(text: Column, pieces: Column) -> Column:
    """Whether the text has each piece. Pieces in the text's order are found without searching it from the beginning."""
    ship()

    def run(texts: pa.Array, pieces: pa.Array) -> pa.Array:
        own, _, _, found, listed = _searched(texts, pieces)
        flags = found.to_pylist()
        if not all(flags):
            row = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False))
            for k in [k for k, flag in enumerate(flags) if flag is False]:
                flags[k] = own[k].as_py() in texts[int(row[k])].as_py()
        return listed(pa.array(flags, pa.bool_()))

    return F.arrow_udf(run, "array<boolean>")(text, pieces)


def sample_places(n: Column, most: int) -> Column:
    """Indices of a systematic sample: all of n, or floor(i * n / most) for i < most."""
    few = lambda v: F.when(v > 0, F.sequence(F.lit(0), (v - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    many = lambda v: F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * (v / F.lit(float(most)))).cast("int"))
    return let(n, lambda v: F.when(v <= most, few(v)).otherwise(many(v)))


def sections(text: Column, headings: Column, most_level: int) -> Column:
    """Texts from each heading of the levels to the next, trimmed; empty ones go. What stands before the first heading is left out."""

    def cut(v: Column) -> Column:
        following = F.slice(v["h"], 2, F.greatest(F.lit(0), F.size(v["h"])))
        return F.zip_with(v["h"], following, lambda h, f: trim(clip(v["t"], h["start"], F.coalesce(f["start"], F.length(v["t"])))))

    kept = F.filter(headings, lambda h: h["level"] <= most_level)
    return F.filter(let(F.struct(text.alias("t"), kept.alias("h")), cut), lambda s: s != "")
