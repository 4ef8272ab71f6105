"""The seven strategies: each takes documents (text, structure) and adds an array of chunks.

A strategy is a frozen dataclass of its settings. `apply` maps a DataFrame with `text` (and `structure`) to one with
`chunks`, `strategy_id`, `requested_strategy_id`, `api_calls`, `tokens_in` and `tokens_out` (estimated from the prompts), row by row;
only judges that join answers back shuffle anything.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, fields
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagelab.functions import kernels as K
from passagelab.functions import text as T
from passagelab.functions.judges import HeuristicJudge, Judge
from passagelab.schema import CHUNK, CHUNKS


@dataclass(frozen=True)
class Setting:
    """What a number may be; `whole` settings are integers."""

    label: str
    least: float
    most: float
    step: float
    whole: bool = True


def chunk(index, text, start, end, located, summary=None, context=None, rationale=None, parent=None, children=None, embedding=None) -> Column:
    """A chunk as a struct in the order of the schema."""
    none = lambda c, kind: F.lit(None).cast(kind) if c is None else c.cast(kind)
    return F.struct(
        index.cast("int").alias("index"),
        text.alias("text"),
        start.cast("int").alias("start"),
        end.cast("int").alias("end"),
        T.estimate_tokens(text).alias("tokens"),
        located.alias("located"),
        none(summary, "string").alias("summary"),
        none(context, "array<string>").alias("context_dependencies"),
        none(rationale, "string").alias("rationale"),
        none(parent, "int").alias("parent_index"),
        none(children, "array<int>").alias("children"),
        none(embedding, "string").alias("embedding_input"),
    ).cast(CHUNK)


def plain_chunks(placed: Column) -> Column:
    return F.transform(placed, lambda p, i: chunk(i, p["text"], p["start"], p["end"], p["located"]))


def _tokens_of_pairs(pairs: Column) -> Column:
    """Estimated tokens of all the pairs' texts together."""
    chars = F.aggregate(pairs, F.lit(0), lambda n, p: n + F.length(p["a"]) + F.length(p["b"]))
    return F.ceil(chars / T.CHARS_PER_TOKEN).cast("int")


@dataclass(frozen=True)
class Strategy:
    id: ClassVar[str] = ""
    label: ClassVar[str] = ""
    settings: ClassVar[dict[str, Setting]] = {}

    def __post_init__(self):
        for name, s in self.settings.items():
            value = getattr(self, name)
            if isinstance(value, bool) or not s.least <= value <= s.most or (s.whole and value != int(value)):
                raise ValueError(f"{self.id}: {name} = {value!r} is not within {s.least} to {s.most}")

    def config(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    def apply(self, df: DataFrame, judge: Judge) -> DataFrame:
        return self._named(self._run(df, judge))

    def _run(self, df: DataFrame, judge: Judge) -> DataFrame:
        raise NotImplementedError

    def _named(self, df: DataFrame) -> DataFrame:
        for column, value in (("strategy_id", F.lit(self.id)), ("api_calls", F.lit(0)), ("tokens_in", F.lit(0)), ("tokens_out", F.lit(0))):
            if column not in df.columns:
                df = df.withColumn(column, value)
        return df.withColumn("requested_strategy_id", F.lit(self.id))


@dataclass(frozen=True)
class RecursiveSemantic(Strategy):
    """Recursive pieces; neighbours that are alike are joined, and pieces that are not coherent are cut once more."""

    id: ClassVar[str] = "recursive_semantic"
    label: ClassVar[str] = "Recursive + Semantic Hybrid"
    settings: ClassVar[dict] = {"target_size": Setting("Target size (chars)", 200, 4096, 1), "coherence": Setting("Coherence threshold", 0, 1, 0.05, False), "merge": Setting("Merge threshold", 0, 1, 0.05, False)}
    target_size: int = 600
    coherence: float = 0.75
    merge: float = 0.92
    true_recursive: bool = False

    def _run(self, df, judge):
        none = F.array().cast("array<string>")
        df = df.withColumn("_items", F.coalesce(K.recursive_split(F.col("text"), self.target_size, self.true_recursive), none))  # a null text has no pieces
        df = judge.pair_scores(df.withColumn("_pairs", K.pairs_of(F.col("_items"))), "_pairs", "_scores")
        several = F.size("_items") > 1
        df = df.withColumn("_merged", F.when(several, K.merge_pairs(F.col("_items"), F.col("_scores"), self.merge)).otherwise(F.col("_items")))
        df = judge.self_scores(df, "_merged", "_self")
        weak = lambda scores: F.transform(scores, lambda x: F.coalesce(x < self.coherence, F.lit(False)))
        df = df.withColumn("_loose", weak(F.col("_self")))
        df = df.withColumn("_parts", F.zip_with("_merged", "_loose", lambda t, loose: F.when(F.coalesce(loose, F.lit(False)), T.sentences(t, 10)).otherwise(none)))
        df = judge.weakest(df, "_parts", "_weakest")

        def cut(x: Column) -> Column:
            own = x["parts"]
            n = F.size(own)
            at = F.greatest(F.lit(1), F.least(F.coalesce(x["weakest"], F.floor(n / 2).cast("int")), n - 1))
            halves = F.array(F.array_join(F.slice(own, 1, F.greatest(at, F.lit(0))), " "), F.array_join(F.slice(own, at + 1, F.greatest(n - at, F.lit(0))), " "))
            return F.when(n > 2, halves).otherwise(F.array(x["text"]))

        together = F.zip_with(F.zip_with("_merged", "_parts", lambda t, p: F.struct(t.alias("text"), p.alias("parts"))), "_weakest", lambda x, w: F.struct(x["text"].alias("text"), x["parts"].alias("parts"), w.alias("weakest")))
        df = df.withColumn("_final", F.flatten(F.transform(together, cut)))
        cuts = F.size(F.filter("_loose", lambda x: x))
        calls = several.cast("int") + F.size("_merged") + cuts
        df = df.withColumn("api_calls", calls).withColumn("tokens_in", F.when(several, _tokens_of_pairs(F.col("_pairs"))).otherwise(F.lit(0))).withColumn("tokens_out", F.when(several, F.size("_scores") * 4).otherwise(F.lit(0)))
        df = df.withColumn("chunks", plain_chunks(K.place(F.col("text"), F.col("_final"))))
        return df.drop("_items", "_pairs", "_scores", "_merged", "_self", "_loose", "_parts", "_weakest", "_final")


@dataclass(frozen=True)
class Late(Strategy):
    """Passages that a judge cuts with the whole text in view; the two settings only tell it what to aim at."""

    id: ClassVar[str] = "late"
    label: ClassVar[str] = "Late Chunking"
    settings: ClassVar[dict] = {"max_tokens": Setting("Max chunk tokens", 64, 512, 32), "window": Setting("Context window", 128, 1024, 64)}
    max_tokens: int = 256
    window: int = 512

    def _run(self, df, judge):
        df = judge.passages(df, "text", "_found", self.max_tokens, self.window).withColumn("api_calls", F.lit(1))
        placed = K.place(F.col("text"), F.transform("_found", lambda x: x["chunk"]))
        df = df.withColumn("_placed", placed)
        both = F.zip_with("_placed", "_found", lambda p, x: F.struct(p.alias("p"), x["contextDependencies"].alias("c")))
        made = F.transform(both, lambda x, i: chunk(i, x["p"]["text"], x["p"]["start"], x["p"]["end"], x["p"]["located"], context=x["c"]))
        return df.withColumn("chunks", F.coalesce(made, F.array().cast(CHUNKS))).drop("_found", "_placed")


@dataclass(frozen=True)
class StructureAware(Strategy):
    """Sections between headings; small neighbours are joined, large ones go to the judge. Without headings the recursive strategy runs."""

    id: ClassVar[str] = "structure_aware"
    label: ClassVar[str] = "Structure-Aware"
    settings: ClassVar[dict] = {"max_tokens": Setting("Max chunk tokens", 128, 1024, 64), "min_tokens": Setting("Min chunk tokens", 20, 300, 10), "levels": Setting("Heading levels", 1, 6, 1)}
    max_tokens: int = 512
    min_tokens: int = 100
    levels: int = 3

    def _run(self, df, judge):
        kept = F.filter("structure.headings", lambda h: h["level"] <= self.levels)
        has = F.coalesce(F.size(kept) > 0, F.lit(False))
        # one pass over the rows: those with headings have no text for the recursive strategy, and the others no sections
        df = df.withColumn("_whole", F.col("text")).withColumn("_has", has).withColumn("text", F.when(~F.col("_has"), F.col("text")))
        plain = RecursiveSemantic(target_size=self.max_tokens * T.CHARS_PER_TOKEN).apply(df, judge)
        own = plain.withColumn("text", F.col("_whole")).withColumn("_items", F.when(F.col("_has"), K.merge_small(K.sections(F.col("text"), F.col("structure.headings"), self.levels), self.min_tokens)))
        large = lambda t: T.estimate_tokens(t) > self.max_tokens
        own = judge.split_sections(own.withColumn("_large", F.filter("_items", large)), "_large", "_split", self.max_tokens)

        def resolved(v: Column) -> Column:
            # the answer for a large item is at the number of large items before it
            before = lambda i: F.size(F.filter(F.slice(v["items"], 1, i), large))
            return F.flatten(F.transform(v["items"], lambda t, i: F.when(large(t), F.coalesce(F.get(v["split"], before(i)), F.array(t))).otherwise(F.array(t))))

        final = T.let(F.struct(F.col("_items").alias("items"), F.col("_split").alias("split")), resolved)
        mine = {"chunks": plain_chunks(K.place(F.col("text"), final)), "api_calls": F.size("_large"), "tokens_in": F.lit(0), "tokens_out": F.lit(0), "strategy_id": F.lit(self.id)}
        for column, value in mine.items():
            own = own.withColumn(column, F.when(F.col("_has"), value).otherwise(F.col(column)))
        return own.drop("_items", "_large", "_split", "_whole", "_has")


@dataclass(frozen=True)
class ParentChild(Strategy):
    """Recursive parents, and children that are overlapping windows of them; a parent comes right before its children."""

    id: ClassVar[str] = "parent_child"
    label: ClassVar[str] = "Parent-Child (Small-to-Big)"
    settings: ClassVar[dict] = {"parent_tokens": Setting("Parent tokens", 256, 1024, 64), "child_tokens": Setting("Child tokens", 32, 256, 16), "overlap": Setting("Child overlap", 0, 64, 8)}
    parent_tokens: int = 512
    child_tokens: int = 128
    overlap: int = 16

    def __post_init__(self):
        super().__post_init__()
        K.check_step(self.child_tokens, self.overlap)

    def _run(self, df, judge):
        size, overlap = self.child_tokens * T.CHARS_PER_TOKEN, self.overlap * T.CHARS_PER_TOKEN
        df = df.withColumn("_parents", K.place(F.col("text"), K.recursive_split(F.col("text"), self.parent_tokens * T.CHARS_PER_TOKEN)))
        df = df.withColumn("_starts", F.transform("_parents", lambda p: K.child_starts(p["text"], size, overlap)))
        counted = lambda v: F.transform(v, lambda s, i: F.struct(s.alias("starts"), F.aggregate(F.slice(v, 1, i), F.lit(0), lambda n, x: n + 1 + F.size(x)).alias("first")))
        df = df.withColumn("_families", F.zip_with("_parents", T.let(F.col("_starts"), counted), lambda p, c: F.struct(p.alias("p"), F.length(p["text"]).alias("n"), c["starts"].alias("starts"), c["first"].alias("first"))))

        def family(x: Column) -> Column:
            p, starts, index = x["p"], x["starts"], x["first"]
            parent = chunk(index, p["text"], p["start"], p["end"], p["located"], children=F.transform(starts, lambda s, k: index + 1 + k))

            def child(s: Column, k: Column) -> Column:
                # a cut or a search goes through the parent's text, so each is made once
                own = T.clip(p["text"], s, F.least(s + size, x["n"]))
                start = lambda t: F.when(p["located"], p["start"] + T.index_of(p["text"], t)).otherwise(F.lit(0))
                placed = lambda v: chunk(index + 1 + k, v["t"], v["s"], v["s"] + F.length(v["t"]), p["located"], parent=index)
                return T.let(own, lambda t: T.let(F.struct(t.alias("t"), start(t).alias("s")), placed))

            return F.concat(F.array(parent), F.transform(starts, child))

        return df.withColumn("chunks", F.flatten(F.transform("_families", family))).drop("_parents", "_starts", "_families")


@dataclass(frozen=True)
class SlidingSummary(Strategy):
    """Overlapping windows of characters, each with a one-sentence summary that its embedding begins with."""

    id: ClassVar[str] = "sliding_window_summary"
    label: ClassVar[str] = "Sliding Window + Summaries"
    settings: ClassVar[dict] = {"size": Setting("Window (chars)", 200, 2000, 100), "overlap": Setting("Overlap (chars)", 0, 400, 50), "summary_words": Setting("Summary words", 10, 80, 5)}
    size: int = 800
    overlap: int = 100
    summary_words: int = 40

    def __post_init__(self):
        super().__post_init__()
        K.check_step(self.size, self.overlap)

    def _run(self, df, judge):
        df = df.withColumn("_starts", K.window_starts(F.col("text"), self.size, self.overlap))
        cut = lambda v: F.transform(v["s"], lambda s: F.substring(v["t"], s + 1, F.lit(self.size)))
        df = df.withColumn("_items", T.let(F.struct(F.col("text").alias("t"), F.col("_starts").alias("s")), cut))
        df = judge.summaries(df, "_items", "_said", self.summary_words)

        both = F.zip_with(F.zip_with("_items", "_starts", lambda t, s: F.struct(t.alias("t"), s.alias("s"))), "_said", lambda x, y: F.struct(x["t"].alias("t"), x["s"].alias("s"), y["text"].alias("summary"), y["error"].alias("error")))
        numbered = F.transform(both, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
        kept = F.filter(numbered, lambda n: n["x"]["error"].isNull() & n["x"]["summary"].isNotNull())

        def one(n: Column) -> Column:
            x = n["x"]
            return chunk(n["i"], x["t"], x["s"], x["s"] + F.length(x["t"]), F.lit(True), summary=x["summary"], embedding=F.concat(x["summary"], F.lit("\n\n"), x["t"]))

        return df.withColumn("chunks", F.transform(kept, one)).withColumn("api_calls", F.size("_items")).drop("_starts", "_items", "_said")


@dataclass(frozen=True)
class KamradtSemantic(Strategy):
    """Sentences grouped between the largest drops of similarity of neighbours."""

    id: ClassVar[str] = "kamradt_semantic"
    label: ClassVar[str] = "Kamradt Semantic Chunker"
    settings: ClassVar[dict] = {"percentile": Setting("Breakpoint percentile", 50, 99, 1), "min_sentences": Setting("Min sentences", 1, 10, 1)}
    percentile: int = 85
    min_sentences: int = 2

    def _run(self, df, judge):
        df = df.withColumn("_items", T.sentences(F.col("text")))
        df = judge.pair_scores(df.withColumn("_pairs", K.pairs_of(F.col("_items"))), "_pairs", "_scores")
        df = df.withColumn("_drops", F.transform("_scores", lambda s: 1 - s))
        few = F.size("_items") <= 1
        df = df.withColumn("tokens_in", F.when(few, 0).otherwise(_tokens_of_pairs(F.col("_pairs")))).withColumn("tokens_out", F.when(few, 0).otherwise(F.size("_pairs") * 4))
        df = K.with_placed_groups(df.drop("_pairs", "_scores"), "_placed", "text", "_items", "_drops", self.percentile, self.min_sentences)
        whole = F.array(chunk(F.lit(0), F.col("text"), F.lit(0), F.length("text"), F.lit(True)))
        df = df.withColumn("chunks", F.when(few, whole).otherwise(plain_chunks(F.col("_placed")))).withColumn("api_calls", F.when(few, 0).otherwise(1))
        return df.drop("_items", "_drops", "_placed")


@dataclass(frozen=True)
class Agentic(Strategy):
    """Atomic statements that a judge makes, with the spans that it claims."""

    id: ClassVar[str] = "agentic"
    label: ClassVar[str] = "Agentic Proposition Chunker"
    settings: ClassVar[dict] = {"max_tokens": Setting("Max statement tokens", 32, 256, 16)}
    max_tokens: int = 64
    resolve: bool = True

    def _run(self, df, judge):
        df = judge.propositions(df, "text", "_found", self.max_tokens, self.resolve)
        why = F.lit("Pronouns and references resolved") if self.resolve else None
        span = lambda x, k, default: F.coalesce(F.get(x["sourceSpan"], F.lit(k)), default)
        one = lambda x, there, i: chunk(i, x["proposition"], span(x, 0, F.lit(0)), span(x, 1, F.length(x["proposition"])), there, rationale=why)
        df = df.withColumn("_there", K.contained(F.col("text"), F.transform("_found", lambda x: x["proposition"])))
        both = F.zip_with("_found", "_there", lambda x, there: F.struct(x.alias("x"), there.alias("there")))
        made = F.transform(both, lambda b, i: one(b["x"], b["there"], i))
        return df.withColumn("chunks", F.coalesce(made, F.array().cast(CHUNKS))).withColumn("api_calls", F.lit(1)).drop("_found", "_there")


REGISTRY: dict[str, type[Strategy]] = {s.id: s for s in (RecursiveSemantic, Late, StructureAware, ParentChild, SlidingSummary, KamradtSemantic, Agentic)}


def register(strategy: type[Strategy]) -> type[Strategy]:
    """Adds a strategy (a class decorator); an id may be taken once."""
    if strategy.id in REGISTRY or not strategy.id:
        raise ValueError(f"the id {strategy.id!r} is taken or empty")
    REGISTRY[strategy.id] = strategy
    return strategy


def make(strategy_id: str, **config) -> Strategy:
    """A strategy by its id; unknown ids and settings are errors."""
    if strategy_id not in REGISTRY:
        raise KeyError(f"no strategy {strategy_id!r}; there are {', '.join(REGISTRY)}")
    kind = REGISTRY[strategy_id]
    if unknown := set(config) - {f.name for f in fields(kind)}:
        raise ValueError(f"{strategy_id} has no setting {', '.join(sorted(unknown))}")
    return kind(**config)


def chunk_rows(df: DataFrame, *keys: str) -> DataFrame:
    """One row for each chunk: the key columns and the chunk's fields."""
    # the outer form, as the optimizer puts a filter with the whole expression of the array below the other one, which computes it twice
    return df.select(*keys, F.explode_outer("chunks").alias("_c")).where("_c is not null").select(*keys, "_c.*")


def chunk_documents(docs: DataFrame, strategy: Strategy, judge: Judge | None = None, key: str = "doc_id") -> DataFrame:
    """(key, strategy_id, chunk fields) of all documents; a document needs `text`, and `structure` where headings count."""
    done = strategy.apply(docs, judge or HeuristicJudge())
    return chunk_rows(done, key, "strategy_id")


Extension = Callable[[DataFrame, Judge], DataFrame]
