"""Judges: what answers a prompt or scores texts.

A judge adds columns to a DataFrame. HeuristicJudge does so by expressions alone; it is a
deterministic stand-in and no language model. TextJudge sends prompts to whatever its `complete`
asks and parses the answers, with one set of defaults for answers that cannot be read. ReplayJudge answers from a
table by the prompt's digest; HttpJudge asks a service from the executors.
"""

from __future__ import annotations

import json
import os
import re
import time
import urllib.request
import warnings
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passagelab.functions import text as T
from passagelab.schema import COMPLETION
from passagelab.shipping import ship

PAIR_CHARS, RANK_CHARS, SELF_CHARS, EDGE_CHARS = 300, 400, 800, 300

#: US dollars per million tokens in and out; a model that is not listed costs what its provider's first does.
PRICES = {
    "anthropic": {"*": (3.0, 15.0)},
    "gemini": {"gemini-2.0-flash": (0.10, 0.40), "gemini-1.5-flash": (0.075, 0.30), "gemini-1.5-pro": (1.25, 5.00)},
    "ollama": {"*": (0.0, 0.0)},
}


def price(provider: str, model: str | None = None) -> tuple[float, float]:
    """US dollars per million tokens in and out."""
    listed = PRICES[provider]
    return listed.get(model or "", next(iter(listed.values())))


class Judge(Protocol):
    name: str
    usd: tuple[float, float]

    def pair_scores(self, df: DataFrame, pairs: str, out: str) -> DataFrame:
        """pairs array<struct<a, b>> to `out` array<double>."""

    def self_scores(self, df: DataFrame, items: str, out: str) -> DataFrame:
        """items array<string> to `out` array<double>: each text's similarity with itself."""

    def weakest(self, df: DataFrame, parts: str, out: str) -> DataFrame:
        """parts array<array<string>> of sentences to `out` array<int>; null is left for the default."""

    def summaries(self, df: DataFrame, items: str, out: str, most_words: int) -> DataFrame:
        """items array<string> to `out` array<struct<text, error>>."""

    def passages(self, df: DataFrame, text: str, out: str, most_tokens: int, window: int) -> DataFrame:
        """text to `out` array<struct<chunk, contextDependencies>>; null if the answer cannot be read."""

    def propositions(self, df: DataFrame, text: str, out: str, most_tokens: int, resolve: bool) -> DataFrame:
        """text to `out` array<struct<proposition, sourceSpan>>; null if the answer cannot be read."""

    def split_sections(self, df: DataFrame, items: str, out: str, most_tokens: int) -> DataFrame:
        """items array<string> to `out` array<array<string>>; null for a part that cannot be split."""

    def self_contained(self, df: DataFrame, text: str, out: str) -> DataFrame:
        """text to `out` double."""

    def boundary(self, df: DataFrame, a: str, b: str, out: str) -> DataFrame:
        """two neighbouring texts to `out` double."""


POINTING = "it its this that these those he she they him her them his their".split()


@dataclass(frozen=True)
class HeuristicJudge:
    """Scores by rules of thumb: shared words, closing punctuation, pronouns, first words, sentences."""

    name: str = "heuristic"
    usd: tuple[float, float] = (0.0, 0.0)

    def pair_scores(self, df, pairs, out):
        # pairs are neighbours of one list: each text's words are made once
        bag = lambda t: T.word_bag(F.left(t, F.lit(PAIR_CHARS)))
        bags = lambda v: F.concat(F.transform(v, lambda p: bag(p["a"])), F.array(bag(F.get(v, F.size(v) - 1)["b"])))
        scores = lambda x: F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), T.bag_jaccard)
        none = F.array().cast("array<double>")
        return df.withColumn(out, T.let(F.col(pairs) if isinstance(pairs, str) else pairs, lambda v: F.when(F.size(v) > 0, T.let(bags(v), scores)).when(F.size(v) == 0, none)))

    def self_scores(self, df, items, out):
        return df.withColumn(out, F.transform(items, lambda _: F.lit(1.0)))

    def weakest(self, df, parts, out):
        return df.withColumn(out, F.transform(parts, lambda _: F.lit(None).cast("int")))

    def summaries(self, df, items, out, most_words):
        # a trimmed text has no empty words unless it is empty; what follows the last word wanted is not split
        first = lambda t: F.array_join(F.slice(F.split(T.trim(t), rf"{T.SPACE}+", most_words + 1), 1, most_words), " ")
        return df.withColumn(out, F.transform(items, lambda t: F.struct(first(t).alias("text"), F.lit(None).cast("string").alias("error"))))

    def passages(self, df, text, out, most_tokens, window):
        return df.withColumn(out, F.transform(T.sentences(F.col(text)), lambda s: F.struct(s.alias("chunk"), F.array().cast("array<string>").alias("contextDependencies"))))

    def propositions(self, df, text, out, most_tokens, resolve):
        from passagelab.functions.kernels import place_in_order

        placed = place_in_order(F.col(text), T.sentences(F.col(text)))
        return df.withColumn(out, F.transform(placed, lambda p: F.struct(p["text"].alias("proposition"), F.array(p["start"], p["end"]).alias("sourceSpan"))))

    def split_sections(self, df, items, out, most_tokens):
        from passagelab.functions.kernels import recursive_split

        return df.withColumn(out, F.transform(items, lambda t: recursive_split(t, most_tokens * T.CHARS_PER_TOKEN)))

    def self_contained(self, df, text, out):
        words = T.lower_words(F.left(F.col(text), F.lit(SELF_CHARS)))
        pointing = F.size(F.filter(words, lambda w: w.isin(POINTING)))
        return df.withColumn(out, 1.0 - pointing / F.greatest(F.size(words), F.lit(1)))

    def boundary(self, df, a, b, out):
        tail = F.right(F.col(a), F.lit(EDGE_CHARS))
        return df.withColumn(out, F.when(F.regexp_like(tail, F.lit(rf"[.!?]{T.SPACE}*\z")), F.lit(1.0)).otherwise(F.lit(0.0)))


SCORE = "struct<score: double>"


@dataclass
class TextJudge:
    """Prompts and parsing; `complete` adds a completion column for a prompt column (null prompts get null)."""

    name: str = "text"
    usd: tuple[float, float] = (3.0, 15.0)

    def complete(self, df: DataFrame, prompt: str, out: str, most_tokens: int) -> DataFrame:
        raise NotImplementedError

    def _each(self, df: DataFrame, prompts: Column, out: str, most_tokens: int) -> DataFrame:
        """`out` array<completion> for an array of prompts; rows are told apart by a digest of all prompts."""
        keyed = df.withColumn("_prompts", prompts).withColumn("_key", F.sha2(F.to_json("_prompts"), 256))
        one = keyed.where(F.size("_prompts") > 0).dropDuplicates(["_key"]).select("_key", F.posexplode("_prompts").alias("_k", "_prompt"))
        done = self.complete(one, "_prompt", "_done", most_tokens)
        back = done.groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_done"))), lambda x: x["_done"]).alias(out))
        empty = F.array().cast(f"array<{COMPLETION}>")
        return keyed.join(back, "_key", "left").withColumn(out, F.coalesce(out, empty)).drop("_prompts", "_key")

    def pair_scores(self, df, pairs, out):
        lines = F.transform(pairs, lambda p, i: F.concat(F.lit("Pair "), i + 1, F.lit("\nA: "), F.left(p["a"], F.lit(PAIR_CHARS)), F.lit("\nB: "), F.left(p["b"], F.lit(PAIR_CHARS))))
        ask = F.concat(F.lit("Rate how similar in meaning the two texts of each pair are, from 0 to 1. Answer with a JSON array of numbers only.\n\n"), F.array_join(lines, "\n\n"))
        asked = self.complete(df.withColumn("_ask", F.when(F.size(pairs) > 0, ask)), "_ask", "_answer", 256)
        said = F.col("_answer.text")
        half = F.transform(pairs, lambda _: F.lit(0.5))
        damaged = F.raise_error(F.concat(F.lit("scores cannot be read: "), said)).cast("array<double>")
        scores = F.when(F.size(pairs) == 0, F.array().cast("array<double>")).when(~T.has_number_list(said), half).otherwise(F.coalesce(T.number_list(said), damaged))
        return asked.withColumn(out, F.coalesce(scores, half)).drop("_ask", "_answer")

    def self_scores(self, df, items, out):
        ask = F.transform(items, lambda t: F.concat(F.lit("Rate how coherent in meaning this text is, from 0 to 1. Answer with a JSON array of one number only.\n\n"), F.left(t, F.lit(PAIR_CHARS))))
        asked = self._each(df, ask, "_answer", 256)
        return asked.withColumn(out, F.transform("_answer", lambda s: F.coalesce(F.get(T.number_list(s["text"]), F.lit(0)), F.lit(0.5)))).drop("_answer")

    def weakest(self, df, parts, out):
        lines = lambda p: F.array_join(F.transform(p, lambda s, i: F.concat(i, F.lit(": "), s)), "\n")
        ask = F.transform(parts, lambda p: F.when(F.size(p) > 2, F.concat(F.lit('Which sentence is tied least to those around it? Answer with a JSON object only: {"index": number}\n\n'), lines(p))))
        asked = self._each(df, ask, "_answer", 64)
        return asked.withColumn(out, F.transform("_answer", lambda s: T.first_object(s["text"], "struct<index: int>")["index"])).drop("_answer")

    def summaries(self, df, items, out, most_words):
        ask = F.transform(items, lambda t: F.concat(F.lit(f"Say in one sentence of at most {most_words} words what this text is about, and nothing else.\n\n"), t))
        asked = self._each(df, ask, "_answer", 80)
        return asked.withColumn(out, F.transform("_answer", lambda s: F.struct(T.trim(s["text"]).alias("text"), s["error"].alias("error")))).drop("_answer")

    def _list(self, df: DataFrame, ask: Column, out: str, most_tokens: int, schema: str) -> DataFrame:
        asked = self.complete(df.withColumn("_ask", ask), "_ask", "_answer", most_tokens)
        return asked.withColumn(out, T.widest_list(F.col("_answer.text"), schema)).drop("_ask", "_answer")

    def passages(self, df, text, out, most_tokens, window):
        rules = f'Cut the text into passages of at most {most_tokens} tokens, with a context of {window} tokens in mind. Answer with a JSON array of {{"chunk": exact text, "contextDependencies": [what it leans on]}} only.\n\n'
        return self._list(df, F.concat(F.lit(rules), F.col(text)), out, 4096, "array<struct<chunk: string, contextDependencies: array<string>>>")

    def propositions(self, df, text, out, most_tokens, resolve):
        extra = " Replace every pronoun and every implicit reference by what it stands for." if resolve else ""
        rules = f'Break the text into atomic statements of at most {most_tokens} tokens.{extra} Answer with a JSON array of {{"proposition": text, "sourceSpan": [start, end]}} only.\n\n'
        return self._list(df, F.concat(F.lit(rules), F.col(text)), out, 8192, "array<struct<proposition: string, sourceSpan: array<int>>>")

    def split_sections(self, df, items, out, most_tokens):
        ask = F.transform(items, lambda t: F.concat(F.lit(f"Cut this section into coherent parts of at most {most_tokens} tokens. Answer with a JSON array of the parts' exact texts only.\n\n"), t))
        asked = self._each(df, ask, "_answer", 256)
        return asked.withColumn(out, F.transform("_answer", lambda s: T.widest_list(s["text"], "array<string>"))).drop("_answer")

    def self_contained(self, df, text, out):
        ask = F.concat(F.lit('How well can this passage be understood by itself, from 0 to 1? Answer with a JSON object only: {"score": number}\n\n'), F.left(F.col(text), F.lit(SELF_CHARS)))
        asked = self.complete(df.withColumn("_ask", ask), "_ask", "_answer", 128)
        return asked.withColumn(out, F.coalesce(T.first_object(F.col("_answer.text"), SCORE)["score"], F.lit(0.5))).drop("_ask", "_answer")

    def boundary(self, df, a, b, out):
        ask = F.concat(F.lit('How natural is the break between these two passages, from 0 to 1? Answer with a JSON object only: {"score": number}\n\nEnd of the first: '), F.right(F.col(a), F.lit(EDGE_CHARS)), F.lit("\n\nBegin of the second: "), F.left(F.col(b), F.lit(EDGE_CHARS)))
        asked = self.complete(df.withColumn("_ask", ask), "_ask", "_answer", 128)
        return asked.withColumn(out, F.coalesce(T.first_object(F.col("_answer.text"), SCORE)["score"], F.lit(0.5))).drop("_ask", "_answer")


@dataclass
class ReplayJudge(TextJudge):
    """Answers from (prompt_sha256, text, input_tokens, output_tokens, error); a prompt that is missing has an error."""

    answers: DataFrame = None
    name: str = "replay"

    def complete(self, df, prompt, out, most_tokens):
        told = self.answers.dropDuplicates(["prompt_sha256"]).select(F.col("prompt_sha256").alias("_sha"), F.struct("text", "input_tokens", "output_tokens", "error").cast(COMPLETION).alias(out))
        missing = F.struct(F.lit(None), F.lit(0), F.lit(0), F.lit("no answer")).cast(COMPLETION)
        joined = df.withColumn("_sha", F.sha2(F.col(prompt).cast("binary"), 256)).join(told, "_sha", "left").drop("_sha")
        return joined.withColumn(out, F.when(F.col(prompt).isNotNull(), F.coalesce(out, missing)))


ANSWERS = "_sha string, text string, input_tokens int, output_tokens int, error string"


@dataclass
class FunctionJudge(TextJudge):
    """Answers by a Python function of (prompt, most_tokens) on the executors, each distinct prompt once.

    answers: the path of a table that keeps answers. They are written there before anything reads them, so a plan that runs again asks (and
    pays) only for prompts that it does not have; answers with an error are asked again. Without it a plan that is computed twice asks twice.
    """

    function: Callable[[str, int], dict] = None
    pause: float = 0.0
    most_partitions: int | None = None
    name: str = "function"
    answers: str | None = None

    def complete(self, df, prompt, out, most_tokens):
        function, pause, spark = self.function, self.pause, df.sparkSession
        df = df.withColumn("_sha", F.sha2(F.concat(F.lit(f"{self.name}\0{most_tokens}\0"), F.col(prompt)).cast("binary"), 256))
        asked = df.where("_sha is not null").select("_sha", F.col(prompt).alias("_p")).dropDuplicates(["_sha"])
        known = self._known(spark) if self.answers else None
        if known is not None:
            asked = asked.join(known.where("error is null").select("_sha"), "_sha", "left_anti")
        if self.most_partitions:
            asked = asked.repartition(self.most_partitions)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = []
                for sha, p in zip(frame["_sha"], frame["_p"]):
                    try:
                        said = function(p, most_tokens)
                        rows.append((sha, said.get("text"), int(said.get("input_tokens", 0)), int(said.get("output_tokens", 0)), None))
                    except Exception as error:  # an answer that fails is a row, not a lost job
                        rows.append((sha, None, 0, 0, str(error)[:500]))
                    time.sleep(pause)
                yield pd.DataFrame(rows, columns=["_sha", "text", "input_tokens", "output_tokens", "error"])

        ship(spark)
        told = asked.mapInPandas(run, ANSWERS)
        if self.answers:
            told.write.mode("append").parquet(self.answers)
            best = F.max_by(F.struct("text", "input_tokens", "output_tokens", "error"), F.col("error").isNull())
            told = self._known(spark).groupBy("_sha").agg(best.alias(out))
        else:
            told = told.select("_sha", F.struct("text", "input_tokens", "output_tokens", "error").alias(out))
        return df.join(told, "_sha", "left").drop("_sha")

    def _known(self, spark) -> DataFrame | None:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.answers)
        exists = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
        return spark.read.schema(ANSWERS).parquet(self.answers) if exists else None


@dataclass(frozen=True)
class Provider:
    """A service that completes prompts. The key is read from the executors' environment and is never a column.

    With `streamed` the answer is asked for token by token and put together, so long answers keep the connection alive; the result is the same.
    """

    kind: str
    model: str
    base_url: str = ""
    key_variable: str = ""
    timeout: float = 120.0
    extra: dict = field(default_factory=dict)
    streamed: bool = False

    def request(self, prompt: str, most_tokens: int) -> tuple[str, dict, dict]:
        """(url, headers, body)."""
        key = os.environ.get(self.key_variable, "") if self.key_variable else ""
        if self.key_variable and not key:
            raise ValueError(f"the environment variable {self.key_variable} has no key")
        if self.kind == "anthropic":
            base = self.base_url or "https://api.anthropic.com"
            return f"{base}/v1/messages", {"x-api-key": key, "anthropic-version": "2023-06-01"}, {"model": self.model, "max_tokens": most_tokens, "messages": [{"role": "user", "content": prompt}], **({"stream": True} if self.streamed else {}), **self.extra}
        if self.kind == "gemini":
            base = self.base_url or "https://generativelanguage.googleapis.com"
            verb = "streamGenerateContent?alt=sse" if self.streamed else "generateContent"
            return f"{base}/v1beta/models/{self.model}:{verb}", {"x-goog-api-key": key}, {"contents": [{"role": "user", "parts": [{"text": prompt}]}], "generationConfig": {"maxOutputTokens": most_tokens}, **self.extra}
        if self.kind == "ollama":
            base = self.base_url or "http://localhost:11434"
            body = {"model": self.model, "stream": self.streamed, "options": {"num_predict": most_tokens}, "messages": [{"role": "user", "content": prompt}], **self.extra}
            return f"{base}/api/chat", {}, body | ({"think": False} if re.search("qwen3", self.model, re.I) else {})
        raise ValueError(f"unknown provider {self.kind}")

    def answer(self, reply: dict) -> dict:
        if self.kind == "anthropic":
            use = reply.get("usage", {})
            return {"text": "".join(p.get("text", "") for p in reply.get("content", [])), "input_tokens": use.get("input_tokens", 0), "output_tokens": use.get("output_tokens", 0)}
        if self.kind == "gemini":
            use = reply.get("usageMetadata", {})
            parts = reply.get("candidates", [{}])[0].get("content", {}).get("parts", [])
            return {"text": "".join(p.get("text", "") for p in parts), "input_tokens": use.get("promptTokenCount", 0), "output_tokens": use.get("candidatesTokenCount", 0)}
        return {"text": reply.get("message", {}).get("content", ""), "input_tokens": reply.get("prompt_eval_count", 0), "output_tokens": reply.get("eval_count", 0)}

    def __call__(self, prompt: str, most_tokens: int) -> dict:
        url, headers, body = self.request(prompt, most_tokens)
        asked = urllib.request.Request(url, json.dumps(body).encode(), {"content-type": "application/json", **headers})
        with urllib.request.urlopen(asked, timeout=self.timeout) as reply:
            return self.gathered(reply) if self.streamed else self.answer(json.load(reply))

    def gathered(self, lines: Iterable[bytes]) -> dict:
        """A streamed answer put together: its text in order, and the last counts of tokens that it names."""
        out = {"text": "", "input_tokens": 0, "output_tokens": 0}
        for line in lines:
            data = line.decode("utf-8", "replace").strip().removeprefix("data:").strip()
            if not data.startswith("{"):
                continue  # names of events, empty lines, an end mark
            part = json.loads(data)
            if part.get("error"):
                raise ValueError(str(part["error"])[:500])
            if self.kind == "anthropic":
                use = part.get("usage") or part.get("message", {}).get("usage") or {}
                said = {"text": part.get("delta", {}).get("text", ""), "input_tokens": use.get("input_tokens", 0), "output_tokens": use.get("output_tokens", 0)}
            else:
                said = self.answer(part)
            out = {"text": out["text"] + (said["text"] or ""), "input_tokens": said["input_tokens"] or out["input_tokens"], "output_tokens": said["output_tokens"] or out["output_tokens"]}
        return out


def http_judge(provider: Provider, pause: float = 0.2, most_partitions: int = 4, answers: str | None = None) -> FunctionJudge:
    """A judge that asks a service: `most_partitions` tasks, each waiting `pause` seconds between calls. answers: a table that keeps them.

    Warns if the key is not in the driver's environment; where the executors have none either, each answer is a row with that error.
    """
    if provider.key_variable and not os.environ.get(provider.key_variable):
        warnings.warn(f"{provider.key_variable} is not set here; the executors need it", stacklevel=2)
    return FunctionJudge(answers=answers, name=f"{provider.kind}:{provider.model}", usd=price(provider.kind, provider.model), function=provider, pause=pause, most_partitions=most_partitions)
