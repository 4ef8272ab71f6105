"""Ranking chunks for queries, judgments of relevance, and precision."""

from collections.abc import Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from passagelab.functions import text as T
from passagelab.functions.judges import RANK_CHARS, TextJudge
from passagelab.shipping import ship

TOP_K = 5
#: Numbers in the vectors of queries that are sent to all tasks at once (64 MB).
BROADCAST_NUMBERS = 8_000_000
#: Items and queries whose scores a task has at once (16 MB).
ITEMS_AT_ONCE, QUERIES_AT_ONCE = 4_096, 512
#: Digits of scores that are compared.
DIGITS = 9


def candidates(chunks: DataFrame, children_only: bool = False) -> DataFrame:
    """Chunks with the text that stands for them in retrieval. All of them by default; with children_only no parents."""
    kept = chunks.where("children is null") if children_only else chunks
    return kept.withColumn("candidate", F.coalesce("embedding_input", "text"))


class Embedder(Protocol):
    def embed(self, df: DataFrame, text: str, out: str) -> DataFrame:
        """Adds `out` array<float> of length one (or zeros) for a text column."""


class HashingEmbedder:
    """Words hashed to `size` signed places; deterministic, without a model, and a stand-in for one."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, df: DataFrame, text: str, out: str) -> DataFrame:
        n = self.size
        words = F.filter(T.lower_words(F.col(text)), lambda w: w != "")
        places = F.transform(words, lambda w: F.struct(F.pmod(F.xxhash64(w), F.lit(n)).cast("int").alias("k"), F.when(F.pmod(F.crc32(w.cast("binary")), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
        raw = T.let(places, lambda at: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.aggregate(F.filter(at, lambda a: a["k"] == k), F.lit(0.0), lambda t, a: t + a["s"])))
        norm = lambda r: F.nullif(F.sqrt(F.aggregate(r, F.lit(0.0), lambda t, v: t + v * v)), F.lit(0.0))
        unit = lambda x: F.transform(x["r"], lambda v: F.coalesce(F.try_divide(v, x["n"]), F.lit(0.0)).cast("float"))
        return df.withColumn(out, T.let(raw, lambda r: T.let(F.struct(r.alias("r"), norm(r).alias("n")), unit)))


class FunctionEmbedder:
    """A Python model: `load` gives a function from a list of texts to a list of vectors, once in each task."""

    def __init__(self, load):
        self.load = load

    def embed(self, df: DataFrame, text: str, out: str) -> DataFrame:
        load = self.load

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = load()
            for batch in batches:
                yield pd.Series([list(map(float, v)) for v in model(batch.fillna("").tolist())])

        ship(df.sparkSession)
        return df.withColumn(out, F.pandas_udf(run, "array<float>").asNondeterministic()(F.col(text)))


def _unit_vectors(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: (rows, vectors of length one, or zeros) of a column of lists. Rows that are null or have a null in them are left out."""
    column = column.cast(pa.list_(pa.float64()))
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    values = column.flatten()
    ends = np.cumsum(sizes)
    bad = sizes == 0
    if values.null_count:
        bad[np.searchsorted(ends, np.flatnonzero(values.is_null().to_numpy(zero_copy_only=False)), "right")] = True
    numbers, out = values.to_numpy(zero_copy_only=False), {}
    for n in np.unique(sizes[~bad]).tolist():
        rows = np.flatnonzero((sizes == n) & ~bad)
        own = numbers[(ends[rows] - n)[:, None] + np.arange(n)]
        norm = np.sqrt(np.einsum("ij,ij->i", own, own))[:, None]
        with np.errstate(invalid="ignore"):
            out[n] = rows, np.where(norm == 0, 0.0, own / np.where(norm == 0, 1.0, norm))
    return out


class _Nearest:
    """The k best items of one group for each query, of all blocks that were added. Scores are compared with DIGITS digits, then the items' `order`, nulls first."""

    def __init__(self, queries: dict[int, tuple[np.ndarray, np.ndarray]], n: int, k: int):
        self.queries, self.n, self.k = queries, n, k
        self.places = np.empty((n, 0), np.int64)  # of each query's best items, in `order`
        self.scores = np.empty((n, 0))
        self.order: pa.Array | None = None

    def add(self, vectors: dict[int, tuple[np.ndarray, np.ndarray]], order: pa.Array) -> None:
        known = 0 if self.order is None else len(self.order)
        every = order if self.order is None else pa.concat_arrays([self.order, order])
        last = np.empty(len(every), np.int64)  # the first item has the greatest number
        last[pc.array_sort_indices(every, null_placement="at_start").to_numpy()] = np.arange(len(every) - 1, -1, -1)
        keep = min(self.k, self.places.shape[1] + len(order))
        places, scores = np.empty((self.n, keep), np.int64), np.empty((self.n, keep))
        for first in range(0, self.n, QUERIES_AT_ONCE):
            end = min(self.n, first + QUERIES_AT_ONCE)
            fresh = np.zeros((end - first, len(order)))
            for size, (rows, own) in self.queries.items():
                a, b = np.searchsorted(rows, [first, end])
                if size in vectors and a < b:
                    found, theirs = vectors[size]
                    dots = own[a:b] @ theirs.T
                    if dots.shape == fresh.shape:
                        fresh = dots
                    else:
                        fresh[np.ix_(rows[a:b] - first, found)] = dots
            held, held_keys = self.places[first:end], _keys(self.scores[first:end], last[self.places[first:end]])
            keys = _keys(fresh, last[known:])
            if held.shape[1] == self.k:  # most items of a block are behind the k that are known
                at, item = np.nonzero(keys > held_keys.min(axis=1)[:, None])
                most = np.bincount(at, minlength=end - first)
                width = int(most.max(initial=0))
                slot = np.arange(len(at)) - np.repeat(np.cumsum(most) - most, most)
                new_keys, new_places, new_scores = np.full((end - first, width), np.iinfo(np.int64).min), np.zeros((end - first, width), np.int64), np.zeros((end - first, width))
                new_keys[at, slot], new_places[at, slot], new_scores[at, slot] = keys[at, item], known + item, fresh[at, item]
            else:
                new_keys, new_places, new_scores = keys, np.broadcast_to(known + np.arange(len(order)), keys.shape), fresh
            all_keys = np.hstack((held_keys, new_keys))
            best = np.argpartition(all_keys, all_keys.shape[1] - keep, axis=1)[:, all_keys.shape[1] - keep :] if all_keys.shape[1] > keep else np.broadcast_to(np.arange(keep), all_keys.shape)
            places[first:end] = np.take_along_axis(np.hstack((held, new_places)), best, 1)
            scores[first:end] = np.take_along_axis(np.hstack((self.scores[first:end], new_scores)), best, 1)
        used, self.places = np.unique(places, return_inverse=True)
        self.places = self.places.reshape(places.shape)
        self.order, self.scores = every.take(pa.array(used)), scores

    def rows(self) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
        """(queries, order, scores)"""
        width = self.places.shape[1]
        step = max(1, 65_536 // max(1, width))
        for first in range(0, self.n if width else 0, step):
            own = self.places[first : first + step]
            yield np.repeat(np.arange(first, first + len(own)), width), self.order.take(pa.array(own.reshape(-1))), self.scores[first : first + step].reshape(-1)


def _rounded(scores: np.ndarray) -> np.ndarray:
    """Scores as whole numbers of DIGITS digits; what is no number comes first, as in Spark's order."""
    with np.errstate(invalid="ignore"):
        return np.rint(np.clip(np.where(np.isnan(scores), np.inf, scores), -1.07, 1.07) * 10**DIGITS).astype(np.int64)


def _keys(scores: np.ndarray, last: np.ndarray) -> np.ndarray:
    keys = _rounded(scores)
    keys <<= 32
    keys += last
    return keys


def rank_by_embedding(queries: DataFrame, items: DataFrame, k: int = TOP_K, within: tuple[str, ...] = ("doc_id", "strategy_id"), order: str = "chunk_index") -> DataFrame:
    """(query_id, within, order, score, rank): the k items of each group that are nearest to each query; ties, of DIGITS digits, by `order`.

    queries: (query_id, query_embedding). Every pair is compared, as matrix products of blocks: blocks of queries with at most BROADCAST_NUMBERS
    numbers are sent to all tasks, which hold a few thousand items at once. For a group whose rows follow each other only `k` rows of a query leave a
    task. A vector without length, with a null or of another length than the query's has the score 0.
    """
    spark = items.sparkSession
    ship(spark)
    queries = queries.select("query_id", "query_embedding")
    numbers = queries.agg(F.coalesce(F.sum(F.size("query_embedding")), F.lit(0))).first()[0]
    dealt = max(1, -(-numbers // BROADCAST_NUMBERS))
    items = items.select(*within, order, "embedding")
    fields = [queries.schema["query_id"], *(items.schema[c] for c in (*within, order))]
    schema = StructType([*fields, StructField("score", DoubleType()), StructField("_rounded", LongType())])

    def near(block: DataFrame) -> DataFrame:
        table = block.toArrow().combine_chunks()
        ids, vectors = (pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in table.columns)
        held = spark.sparkContext.broadcast((ids, _unit_vectors(vectors)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, vectors = held.value
            group, state = None, None

            def done() -> Iterator[pa.RecordBatch]:
                for own, places, scores in state.rows() if state else ():
                    same = [pa.repeat(g, len(own)) for g in group]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(own)), *same, places, pa.array(scores), pa.array(_rounded(scores))], schema.names)

            for batch in batches:
                for a, b in _runs_of(batch, len(within)):
                    own = [batch.column(c)[a] for c in range(len(within))]
                    if own != group:
                        yield from done()
                        group, state = own, _Nearest(vectors, len(ids), k)
                    for first in range(a, b, ITEMS_AT_ONCE):
                        piece = batch.slice(first, min(b - first, ITEMS_AT_ONCE))
                        state.add(_unit_vectors(piece.column("embedding")), piece.column(order))
            yield from done()

        return items.mapInArrow(run, schema)

    blocks = [queries] if dealt == 1 else [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(dealt)) == b) for b in range(dealt)]
    scored = reduce(DataFrame.unionByName, map(near, blocks))
    w = Window.partitionBy("query_id", *within).orderBy(F.col("_rounded").desc(), order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_rounded")


def _runs_of(batch: pa.RecordBatch, columns: int) -> list[tuple[int, int]]:
    """Runs of rows that have the same first `columns` values."""
    n = batch.num_rows
    new = np.zeros(n + 1, bool)
    new[[0, n]] = True
    for c in batch.columns[:columns]:
        code = c.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:n] |= code[1:] != code[:-1]
    edges = np.flatnonzero(new).tolist()
    return list(zip(edges, edges[1:])) if n else []


def rank_by_judge(queries: DataFrame, chunks: DataFrame, judge: TextJudge, k: int = TOP_K) -> DataFrame:
    """Rankings that a judge returns, in its order; a place is counted before chunks that do not exist are dropped.

    One prompt for each query and run holds all its candidates, 400 characters of each.
    """
    listed = candidates(chunks).groupBy("doc_id", "strategy_id").agg(F.array_sort(F.collect_list(F.struct("index", F.left("candidate", F.lit(RANK_CHARS)).alias("t")))).alias("c"))  # one run's chunks
    asked = listed.join(queries.select("query_id", "query"), how="cross")
    lines = F.array_join(F.transform("c", lambda x: F.concat(x["index"], F.lit(": "), x["t"])), "\n")
    ask = F.concat(F.lit(f'Rank the {k} passages that answer the query best. Answer with a JSON array of {{"index": number, "score": number from 0 to 1}} only.\n\nQuery: '), F.col("query"), F.lit("\n\n"), lines)
    said = judge.complete(asked.withColumn("_ask", ask), "_ask", "_said", 512)
    found = F.slice(T.first_list(F.col("_said.text"), "array<struct<index: int, score: double>>"), 1, k)
    ranks = said.select("query_id", "doc_id", "strategy_id", F.posexplode(found).alias("p", "r")).select("query_id", "doc_id", "strategy_id", F.col("r.index").alias("chunk_index"), F.col("r.score").alias("score"), (F.col("p") + 1).alias("rank"))
    known = chunks.select("doc_id", "strategy_id", F.col("index").alias("chunk_index"))
    return ranks.join(known, ["doc_id", "strategy_id", "chunk_index"])


def run_query(queries: DataFrame, chunks: DataFrame, embedder: Embedder | None = None, judge: TextJudge | None = None, k: int = TOP_K) -> DataFrame:
    """Rankings by embedding, or by the judge if there is no embedder or it cannot be set up.

    queries: (query_id, query). A query that is blank is an error.
    """
    if queries.where(T.trim(F.coalesce("query", F.lit(""))) == "").limit(1).count():
        raise ValueError("a query is blank")
    if embedder is not None:
        try:
            vectors = embedder.embed(queries, "query", "query_embedding")
            items = embedder.embed(candidates(chunks), "candidate", "embedding").withColumnRenamed("index", "chunk_index")
            return rank_by_embedding(vectors, items, k)
        except Exception:
            if judge is None:
                raise
    if judge is None:
        raise ValueError("there is neither an embedder nor a judge")
    return rank_by_judge(queries, chunks, judge, k)


def small_to_big(chunks: DataFrame) -> DataFrame:
    """Chunks with their parent's text (null for those without a parent)."""
    parents = chunks.where("children is not null").select("doc_id", "strategy_id", F.col("index").alias("parent_index"), F.col("text").alias("parent_text"))
    return chunks.join(parents, ["doc_id", "strategy_id", "parent_index"], "left")


def latest_judgments(judgments: DataFrame) -> DataFrame:
    """The last judgment of each (query_id, strategy_id, chunk_index) by `ts`; of equal times a true one."""
    w = Window.partitionBy("query_id", "strategy_id", "chunk_index").orderBy(F.col("ts").desc(), F.col("relevant").desc())
    return judgments.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def precision_at(rankings: DataFrame, judgments: DataFrame, k: int = TOP_K) -> DataFrame:
    """(query_id, strategy_id, k, precision): relevant share of the top k that were returned; null below min(3, k) judged ones."""
    top = rankings.where(F.col("rank") <= k).select("query_id", "strategy_id", "chunk_index")
    joined = top.join(judgments.select("query_id", "strategy_id", "chunk_index", "relevant"), ["query_id", "strategy_id", "chunk_index"], "left")
    sums = joined.groupBy("query_id", "strategy_id").agg(F.count("*").alias("n"), F.count("relevant").alias("judged"), F.sum(F.coalesce(F.col("relevant").cast("int"), F.lit(0))).alias("hits"))
    return sums.select("query_id", "strategy_id", F.lit(k).alias("k"), F.when(F.col("judged") >= min(3, k), F.col("hits") / F.col("n")).alias("precision"))


def judged_only(rankings: DataFrame, judgments: DataFrame) -> DataFrame:
    return rankings.join(judgments, ["query_id", "strategy_id", "chunk_index"], "left_semi")
