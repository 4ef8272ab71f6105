"""How good chunks are: judged samples, statistics, composites, and tables of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from passagelab.functions import kernels as K
from passagelab.functions import text as T
from passagelab.functions.judges import HeuristicJudge, Judge

SELF_SAMPLE, BOUNDARY_SAMPLE = 10, 8
AXES = (("avg_self_containedness", "Self-Containedness"), ("avg_boundary_coherence", "Boundary Coherence"), ("token_efficiency", "Token Efficiency"), ("retrieval_precision", "Retrieval Precision"), ("chunk_uniformity", "Chunk Uniformity"))


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def sampled(runs: DataFrame, most: int) -> DataFrame:
    """(doc_id, strategy_id, text) of a systematic sample of each run's chunks. runs: one row with `chunks` for each run."""
    texts = T.let(F.col("chunks"), lambda c: F.transform(K.sample_places(F.size(c), most), lambda i: F.get(c, i)["text"]))
    return runs.select("doc_id", "strategy_id", F.explode_outer(texts).alias("text")).where("text is not null")


def sampled_pairs(runs: DataFrame, most: int) -> DataFrame:
    """(doc_id, strategy_id, a, b): a systematic sample of neighbouring chunks."""
    both = lambda c, i: F.struct(F.get(c, i)["text"].alias("a"), F.get(c, i + 1)["text"].alias("b"))
    pairs = T.let(F.col("chunks"), lambda c: F.transform(K.sample_places(F.greatest(F.size(c) - 1, F.lit(0)), most), lambda i: both(c, i)))
    return runs.select("doc_id", "strategy_id", F.explode_outer(pairs).alias("p")).where("p is not null").select("doc_id", "strategy_id", "p.a", "p.b")


def words_of(chunks: str) -> Column:
    """struct(useful, words) over all chunks' texts, each of which is split once."""
    count = lambda w: F.struct(T.useful(w).alias("u"), F.size(w).alias("w"))
    begin = F.struct(F.lit(0).cast("long").alias("useful"), F.lit(0).cast("long").alias("words"))
    add = lambda n, x: F.struct((n["useful"] + x["u"]).alias("useful"), (n["words"] + x["w"]).alias("words"))
    return F.aggregate(F.transform(chunks, lambda c: T.let(T.lower_words(c["text"]), count)), begin, add)


SUMS = ("n", "t", "tt", "useful", "words", "indexed")


def judged(runs: DataFrame, judge: Judge, self_sample: int, boundary_sample: int) -> DataFrame:
    """One row for each sampled chunk or pair of neighbours of each run, and one for a run without any, in one pass over the chunks.

    SUMS: chunks, tokens, squares of tokens, useful and all words, and tokens that are indexed, of the whole run; they stand in its first row only, the others
    have 0. own and edge: the judged scores, null where the row is no chunk or no pair. runs: one row with `chunks` for each run.
    """
    total = lambda f: F.aggregate("chunks", F.lit(0).cast("long"), lambda n, c: n + f(c))
    none = F.lit(None).cast("string")
    chunk = lambda c, i: F.struct(F.get(c, i)["text"].alias("text"), none.alias("a"), none.alias("b"))
    pair = lambda c, i: F.struct(none.alias("text"), F.get(c, i)["text"].alias("a"), F.get(c, i + 1)["text"].alias("b"))
    own = T.let(F.col("chunks"), lambda c: F.transform(K.sample_places(F.size(c), self_sample), lambda i: chunk(c, i)))
    edges = T.let(F.col("chunks"), lambda c: F.transform(K.sample_places(F.greatest(F.size(c) - 1, F.lit(0)), boundary_sample), lambda i: pair(c, i)))
    runs = runs.withColumn("_words", words_of("chunks"))
    rows = runs.select(
        "doc_id",
        "strategy_id",
        F.size("chunks").cast("long").alias("n"),
        total(lambda c: c["tokens"]).alias("t"),
        total(lambda c: c["tokens"].cast("long") * c["tokens"]).alias("tt"),
        F.col("_words.useful").alias("useful"),
        F.col("_words.words").alias("words"),
        total(lambda c: T.estimate_tokens(F.coalesce(c["embedding_input"], c["text"]))).alias("indexed"),
        F.posexplode_outer(F.concat(own, edges)).alias("place", "sample"),
    )
    first = F.coalesce("place", F.lit(0)) == 0
    rows = rows.select("doc_id", "strategy_id", *[F.when(first, F.col(c)).otherwise(F.lit(0).cast("long")).alias(c) for c in SUMS], "sample.text", "sample.a", "sample.b")
    rows = judge.boundary(judge.self_contained(rows, "text", "own"), "a", "b", "edge")
    return rows.withColumn("own", F.when(F.col("text").isNotNull(), F.col("own"))).withColumn("edge", F.when(F.col("a").isNotNull(), F.col("edge")))


def measured(rows: DataFrame, *key: str) -> DataFrame:
    """One row of metrics for each key of judged(): means of scores, ratios of sums, and the spread of all chunks."""
    sums = rows.groupBy(*key).agg(*[F.sum(c).alias(c) for c in SUMS], F.avg("own").alias("own"), F.avg("edge").alias("edge"))
    mean = F.try_divide(F.col("t"), F.col("n"))
    return sums.select(
        *key,
        F.col("n").alias("chunk_count"),
        zero(mean).alias("avg_tokens"),
        zero(F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("tt"), F.col("n")) - mean * mean))).alias("std_dev_tokens"),
        zero(F.try_divide(F.col("useful"), F.col("words"))).alias("token_efficiency"),
        T.tokens_to_usd(F.col("indexed"), F.lit(0)).alias("estimated_index_cost"),
        zero(F.col("own")).alias("avg_self_containedness"),
        zero(F.col("edge")).alias("avg_boundary_coherence"),
    )


def chunk_stats(runs: DataFrame) -> DataFrame:
    """Counts, tokens, efficiency and index cost of each run, by folds within its row."""
    total = lambda f: F.aggregate("chunks", F.lit(0).cast("long"), lambda n, c: n + f(c))
    sums = runs.withColumn("_words", words_of("chunks")).select(
        "doc_id",
        "strategy_id",
        F.size("chunks").alias("chunk_count"),
        total(lambda c: c["tokens"]).alias("_tokens"),
        F.col("_words.useful").alias("_useful"),
        F.col("_words.words").alias("_words"),
        total(lambda c: T.estimate_tokens(F.coalesce(c["embedding_input"], c["text"]))).alias("_indexed"),
        F.transform("chunks", lambda c: c["tokens"]).alias("_each"),
    )
    mean = zero(F.try_divide(F.col("_tokens"), F.col("chunk_count")))
    sums = sums.withColumn("avg_tokens", mean)
    spread = T.let(F.struct(F.col("_each").alias("e"), F.col("avg_tokens").alias("m")), lambda v: F.aggregate(v["e"], F.lit(0.0), lambda s, t: s + (t - v["m"]) * (t - v["m"])))
    return sums.select(
        "doc_id",
        "strategy_id",
        "chunk_count",
        "avg_tokens",
        zero(F.sqrt(F.try_divide(spread, F.col("chunk_count")))).alias("std_dev_tokens"),
        zero(F.try_divide(F.col("_useful"), F.col("_words"))).alias("token_efficiency"),
        T.tokens_to_usd(F.col("_indexed"), F.lit(0)).alias("estimated_index_cost"),
    )


def composite(df: DataFrame) -> Column:
    """The mean of the three scores, or of four with a retrieval precision."""
    three = F.col("avg_self_containedness") + F.col("avg_boundary_coherence") + F.col("token_efficiency")
    if "retrieval_precision" not in df.columns:
        return three / 3
    return F.when(F.col("retrieval_precision").isNull(), three / 3).otherwise((three + F.col("retrieval_precision")) / 4)


def evaluate(runs: DataFrame, judge: Judge | None = None, self_sample: int = SELF_SAMPLE, boundary_sample: int = BOUNDARY_SAMPLE, precision: DataFrame | None = None) -> DataFrame:
    """One row of metrics for each run (doc_id, strategy_id, chunks); a run with an `error` has zeros and its chunk count.

    precision: (doc_id, strategy_id, retrieval_precision), if known.
    """
    key = ["doc_id", "strategy_id"]
    out = measured(judged(runs, judge or HeuristicJudge(), self_sample, boundary_sample), *key).withColumn("chunk_count", F.col("chunk_count").cast("int"))
    out = out.join(precision, key, "left") if precision is not None else out.withColumn("retrieval_precision", F.lit(None).cast("double"))
    if "error" in runs.columns:
        failed = runs.where("error is not null").select(*key, F.lit(True).alias("_failed"))
        out = out.join(failed, key, "left")
        for c in ("avg_self_containedness", "avg_boundary_coherence", "token_efficiency", "avg_tokens", "std_dev_tokens", "estimated_index_cost"):
            out = out.withColumn(c, F.when(F.col("_failed"), 0.0).otherwise(F.col(c)))
        out = out.drop("_failed")
    return out.withColumn("composite", composite(out))


def by_strategy(runs: DataFrame, judge: Judge | None = None, self_sample: int = SELF_SAMPLE, boundary_sample: int = BOUNDARY_SAMPLE) -> DataFrame:
    """One row of metrics for each strategy over all its documents: means of scores, ratios of sums, and the spread of all chunks."""
    out = measured(judged(runs, judge or HeuristicJudge(), self_sample, boundary_sample), "strategy_id")
    return out.withColumn("composite", composite(out))


def ranked(metrics: DataFrame, order: str = "strategy_id", *within: str) -> DataFrame:
    """Metrics with `rank` by composite (ties: by `order`) and `top` for the first."""
    w = Window.partitionBy(*within).orderBy(F.col("composite").desc(), order)
    return metrics.withColumn("rank", F.row_number().over(w)).withColumn("top", F.col("rank") == 1)


def radar(metrics: DataFrame, strategies: list[str]) -> DataFrame:
    """Five axes by strategy, with 3 digits; missing values are 0. metrics: one row for each strategy."""
    most = F.greatest(F.max("std_dev_tokens").over(Window.partitionBy()), F.lit(1.0))
    known = metrics if "retrieval_precision" in metrics.columns else metrics.withColumn("retrieval_precision", F.lit(None).cast("double"))
    known = known.withColumn("chunk_uniformity", 1 - F.col("std_dev_tokens") / most)
    long = known.select("strategy_id", F.explode(F.array(*[F.struct(F.lit(label).alias("axis"), F.round(zero(F.col(c)), 3).alias("value")) for c, label in AXES])).alias("x"))
    return long.select("strategy_id", "x.*").groupBy("axis").pivot("strategy_id", strategies).agg(F.first("value")).fillna(0.0)


def call_costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Calls, tokens and cost by provider and model. calls: (provider, model, input_tokens, output_tokens); a model without a price takes its provider's default (model '*')."""
    sums = calls.groupBy("provider", "model").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    own = prices.select("provider", "model", F.col("usd_in_per_m").alias("i"), F.col("usd_out_per_m").alias("o"))
    default = prices.where("model = '*'").select("provider", F.col("usd_in_per_m").alias("di"), F.col("usd_out_per_m").alias("do"))
    joined = sums.join(own, ["provider", "model"], "left").join(default, "provider", "left")
    usd = F.col("input_tokens") / 1_000_000 * F.coalesce("i", "di") + F.col("output_tokens") / 1_000_000 * F.coalesce("o", "do")
    return joined.select("provider", "model", "calls", "input_tokens", "output_tokens", usd.alias("usd"))
