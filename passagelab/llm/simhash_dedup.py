"""SimHash near-duplicates by deletion-variant signatures.

Two fingerprints of 64 bits that differ in at most two bits differ in at most one bit of one of
their two halves. Each half is therefore indexed under its 32 variants with one bit wiped out
(one wildcard); equal variants are joined and verified. A variant shared by more fingerprints than
`crowd` would give a square of pairs: its members are indexed under all 2,016 variants of the
whole fingerprint with two bits wiped out instead, where at most four fingerprints can meet.

Copies are folded into their fingerprint first, so a group of equal texts costs one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagelab.llm.common import forget, map_batches, small, written
from passagelab.llm.components import components

BITS, HALF, MOST_BITS, SHINGLE, SEED = 64, 32, 2, 3, 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of a text: a bit is 1 if it is set in over half of the shingles' hashes.

    Words are runs without ASCII white space, A-Z lower-cased. Fewer words than a shingle has:
    the whole sequence is the only shingle. No words (or null): zero.
    """
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = counts * 2 > len(hashes)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, text_hash, fp long) of each row; fp holds the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py(), shingle) for x in batch.column("text")]
            values = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_hash"), pa.array(values)], ["id", "text_hash", "fp"])

    text = F.col(text_col).cast("string")
    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return map_batches(chosen, run, "id long, text_hash long, fp long")


def _close(a: str, b: str):
    return F.expr(f"bit_count({a} ^ {b}) <= {MOST_BITS}")


def variants(nodes: DataFrame) -> DataFrame:
    """(fp, key): key holds the number of the wiped bit and the rest of its half."""
    keys = F.expr(
        f"""transform(sequence(0, {BITS - 1}), j -> shiftleft(cast(j as bigint), {HALF})
            | (if(j < {HALF}, fp & {(1 << HALF) - 1}L, shiftrightunsigned(fp, {HALF})) & ~shiftleft(1L, j % {HALF})))"""
    )
    return nodes.select("fp", F.explode(keys).alias("key"))


def links(nodes: DataFrame, crowd: int = 64) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints (fp) within two bits of each other.

    Within a crowded variant only edges that are needed for connection are kept; every other
    pair within two bits is an edge.
    """
    keys = variants(nodes)
    shared = written(keys.groupBy("key").count().where("count > 1"), "variants")
    met = written(keys.join(shared, "key"), "met")
    thin = met.where(F.col("count") <= crowd).select("key", "fp")
    pairs = (
        thin.select("key", F.col("fp").alias("a"))
        .join(thin.select("key", F.col("fp").alias("b")), "key")
        .where((F.col("a") > F.col("b")) & _close("a", "b"))
        .select("a", "b")
        .distinct()
    )
    crowded = met.where(F.col("count") > crowd).select("fp").distinct()
    masks = [(1 << i) | (1 << j) for i in range(BITS) for j in range(i)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    wiped = crowded.select("fp", F.explode(F.array(*[F.lit(m) for m in signed])).alias("mask"))
    few = wiped.groupBy("mask", F.col("fp").bitwiseAND(F.bitwise_not("mask")).alias("rest")).agg(F.min("fp").alias("b"), F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    stars = few.select(F.explode("all").alias("a"), "b").where("a > b")
    out = written(pairs.union(stars.select("a", "b")).distinct(), "links")
    forget(shared, met)
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, crowd: int = 64) -> DataFrame:
    """(id, fp, component, copies): component is the smallest id reachable over links of two bits or fewer.

    One row for each input row. Null ids keep their fingerprint; a group of nothing but null ids
    has a null component. Null, empty and white-space texts share the fingerprint zero and link
    like any other. `copies` counts the rows with the same fingerprint. An empty table gives an
    empty result; other columns are ignored.
    """
    prints, named = _classes(docs, id_col, text_col, shingle, crowd)
    return prints.join(small(named, named.count()), "fp").select("id", "fp", "component", "copies")


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """(id, text_hash, fp) of each row, and (fp, root, component, copies) of each fingerprint."""
    prints = written(fingerprints(docs, id_col, text_col, shingle), "prints")
    nodes = written(prints.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("copies")), "nodes")
    edges = links(nodes.select("fp"), crowd)
    grouped = nodes.join(components(edges).withColumnRenamed("node", "fp"), "fp", "left")
    grouped = grouped.withColumn("root", F.coalesce("component", "fp")).drop("component")
    linked = grouped.groupBy("root").agg(F.min("first").alias("component"))
    named = written(grouped.join(linked, "root").select("fp", "root", "component", "copies"), "classes")
    forget(edges, nodes)
    return prints, named


def keep_one(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """documents without all but one of each group of near-duplicates: the one with the smallest doc_id stays (null ids come last).

    Rows that repeat a doc_id are told apart by their texts (ties: the smaller hash stays), and of rows that repeat both one stays.
    """
    prints, named = _classes(docs, "doc_id", "text", shingle, 64)
    row = F.struct(F.col("id").isNull().alias("unknown"), "id", "text_hash")
    first = prints.join(small(named, named.count()), "fp").groupBy("root").agg(F.min(row).alias("first")).select("first.id", "first.text_hash").distinct()
    kept = written(first, "kept")
    forget(prints, named)
    same = docs["doc_id"].cast("long").eqNullSafe(kept["id"]) & (F.xxhash64(docs["text"].cast("string")) == kept["text_hash"])
    return docs.join(small(kept, kept.count()), same, "left_semi").dropDuplicates(["doc_id", "text"])
