"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, fixed by the seed. A trigram's vector binds its letters by
multiplication after permuting (rotating) them by their place; a text's vector bundles (adds)
those of its trigrams, and a language's prototype bundles the texts of that language. A
document gets the language whose prototype has the largest cosine with its vector.

Letters are lower-cased; everything between them counts as one space. Sums run over whole texts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagelab.llm.common import free_name, map_batches

UNKNOWN = "und"
DIMENSIONS, SEED = 1024, 20_011
SPACE, WIDE = 32, np.int64(21)
#: Trigram vectors that a task remembers (4 MB for a thousand); others are made again when met.
REMEMBERED = 12_000
#: Counts that a training task holds before it passes them on.
MOST_COUNTS = 200_000

_letter_table: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _letter_table
    if _letter_table is None:
        _letter_table = np.fromiter((chr(k).isalpha() for k in range(0x110000)), bool, 0x110000)
    return _letter_table


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of a text, each packed into a long, and their counts; none if it has no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _letters()[points]
    if not is_letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    points = np.concatenate(([SPACE], np.where(is_letter, points, SPACE), [SPACE])).astype(np.int64)
    gap = points == SPACE
    points = points[np.concatenate(([True], ~(gap[1:] & gap[:-1])))]
    grams = (points[:-2] << (2 * WIDE)) | (points[1:-1] << WIDE) | points[2:]
    return np.unique(grams, return_counts=True)


class Space:
    """Vectors of letters and trigrams."""

    def __init__(self, dimensions: int, seed: int):
        self.dimensions, self.seed = dimensions, seed
        self.of_letter: dict[int, np.ndarray] = {}
        self.of_gram: dict[int, int] = {}
        self.rows = np.empty((0, dimensions), np.float32)

    def letter(self, point: int) -> np.ndarray:
        if point not in self.of_letter:
            bits = np.random.Generator(np.random.Philox(key=[self.seed, point])).integers(0, 2, self.dimensions)
            self.of_letter[point] = (bits * 2 - 1).astype(np.float32)
        return self.of_letter[point]

    def bind(self, grams: np.ndarray) -> np.ndarray:
        """One row for each trigram."""
        low = (1 << int(WIDE)) - 1
        out = np.ones((len(grams), self.dimensions), np.float32)
        for place in range(3):
            points, which = np.unique((grams >> (int(WIDE) * (2 - place))) & low, return_inverse=True)
            out *= np.stack([np.roll(self.letter(int(p)), 2 - place) for p in points])[which]
        return out

    def bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum of the trigrams' vectors, each times its count."""
        total = np.zeros(self.dimensions, np.float64)
        for k in range(0, len(grams), 4096):
            total += self._bundle(grams[k : k + 4096], counts[k : k + 4096])
        return total

    def _bundle(self, grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
        keys = grams.tolist()
        new = [g for g in keys if g not in self.of_gram]
        if len(self.of_gram) + len(new) > REMEMBERED:
            self.of_gram, self.rows, new = {}, self.rows[:0], keys
        if new:
            have = len(self.of_gram)
            if have + len(new) > len(self.rows):
                grown = np.empty((min(REMEMBERED, max(1024, 2 * (have + len(new)))), self.dimensions), np.float32)
                grown[:have] = self.rows[:have]
                self.rows = grown
            self.rows[have : have + len(new)] = self.bind(np.array(new, np.int64))
            self.of_gram.update(zip(new, range(have, have + len(new))))
        at = self.of_gram
        return counts.astype(np.float32) @ self.rows[[at[g] for g in keys]]


@dataclass(frozen=True)
class Model:
    """Languages in ascending order and their prototypes, each of length one."""

    languages: tuple[str, ...]
    prototypes: np.ndarray
    dimensions: int = DIMENSIONS
    seed: int = SEED


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS, seed: int = SEED, most_languages: int = 1000) -> Model:
    """Bundles the texts of each language; rows without a language or a letter teach nothing.

    What reaches the driver is one vector for each language, of which there may be `most_languages`.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[int, int]] = defaultdict(lambda: defaultdict(int))
        size = 0
        for batch in batches:
            waiting: dict[str, list] = defaultdict(list)
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
                waiting[lang].append(trigrams(text.as_py()))
            for lang, found in waiting.items():
                grams, which = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                sums = np.bincount(which, np.concatenate([n for _, n in found]), len(grams))
                counts = held[lang]
                for g, n in zip(grams.tolist(), sums.tolist()):
                    counts[g] += int(n)
            size = sum(map(len, held.values()))
            if size > MOST_COUNTS:
                yield from _counted(held)
                held.clear()
        yield from _counted(held)

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        vectors = Space(dimensions, seed)
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            grams, counts = batch.column("gram").to_numpy(), batch.column("n").to_numpy()
            for lang in set(langs.tolist()):
                own = langs == lang
                sums[lang] = sums.get(lang, 0) + vectors.bundle(grams[own], counts[own])
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "vector": pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))})

    chosen = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = map_batches(chosen, count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    parts = map_batches(counts, bundle, "lang string, vector array<double>")
    sums = parts.select("lang", F.posexplode("vector").alias("k", "x")).groupBy("lang", "k").agg(F.sum("x").alias("x"))
    rows = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("v")).limit(most_languages + 1).collect()
    if len(rows) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    rows.sort(key=lambda r: r["lang"])
    vectors = np.array([[x["x"] for x in r["v"]] for r in rows]).reshape(len(rows), dimensions)
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return Model(tuple(r["lang"] for r in rows), vectors / np.where(lengths, lengths, 1), dimensions, seed)


def _counted(held: dict[str, dict[int, int]]) -> Iterator[pa.RecordBatch]:
    for lang, counts in held.items():
        if counts:
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(counts), "gram": pa.array(list(counts), pa.int64()), "n": pa.array(list(counts.values()), pa.int64())})


def predict_text(text: str | None, model: Model, vectors: Space) -> tuple[str, float]:
    grams, counts = trigrams(text)
    if not len(grams) or not model.languages:
        return UNKNOWN, 0.0
    vector = vectors.bundle(grams, counts)
    cosines = model.prototypes @ (vector / max(np.linalg.norm(vector), 1e-12))
    best = int(np.argmax(np.round(cosines, 9)))
    return model.languages[best], float(min(1.0, max(0.0, cosines[best])))


def predict(docs: DataFrame, model: Model, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with lang_pred and score (or other `names`) (the cosine, not below 0); nothing but the text decides.

    Null texts and texts without a letter are `und` with score 0, as is every text if no
    language was learned. Ties go to the language that sorts first. Equal texts get equal
    results; an empty table stays empty. Columns that have these names are replaced.
    """
    kept = [c for c in docs.columns if c not in names]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(kept).schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Space(model.dimensions, model.seed)
        for batch in batches:
            found = [predict_text(x.as_py(), model, vectors) for x in batch.column(text_col)]
            langs, scores = [x for x, _ in found], [x for _, x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, *names])

    return map_batches(docs.select(kept), run, f"{schema}, `{names[0]}` string, `{names[1]}` double")


def held_out(id_col: str = "doc_id"):
    """True for the fold that training never sees; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """documents with held_out, lang_pred and score, learned from the rows that are not held out."""
    docs = docs.withColumn("held_out", held_out())
    model = train(docs.where("not held_out"))
    return predict(docs, model)


def keep_identified(docs: DataFrame) -> DataFrame:
    """documents whose language can be told: those that are `und` go, all others stay unchanged, with all their columns, under any name.

    Null and empty texts and texts without a letter go; rows that repeat an id or a text are judged each by itself, and so alike; null ids are never held
    out of the training; ties go to the language that sorts first, and the row stays. An empty table stays empty; if no language can be learned, all rows go.
    """
    model = train(docs.where(~held_out()))
    names = (free_name(docs, "lang_pred"), free_name(docs, "score"))
    return predict(docs, model, names=names).where(F.col(names[0]) != UNKNOWN).select(docs.columns)
