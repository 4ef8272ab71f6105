"""Payload columns by content-defined chunking, with a deduplicated chunk store.

A payload is cut where a rolling gear hash of its last 32 bytes has low zero bits, between a least and a
largest chunk size; equal passages so give equal chunks wherever they stand. Storing takes three steps:

1. Every task cuts its payloads and appends each chunk that it has not met to its pack file, a file of compressed
   blocks in the shared folder. What leaves the task is small: for each row the digest of its payload, for
   each distinct payload the ordered list of its chunks, for each chunk its digest and place.
2. Spark joins on the digests: one place is chosen for each chunk, and one recipe for each payload. Copies of a
   payload, however many, are one recipe.
3. Recipes are resolved to places and grouped by the pack that holds most of them; tasks read the chunks back,
   verify every digest, put the stored form and the payload together, and compute the features.

The stored form of a payload of samples (unsigned, 8 bits) is: the magic bytes, the number of samples, the number of
chunks, the chunks' sizes and digests, and the samples. It has no place in it, so equal payloads are stored equally.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import OrderedDict, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagelab.llm.common import map_batches, new_folder, written

UNIT = 64
LEAST, MASK_BITS, MOST = 512, 11, 8192
BLOCK = 1 << 18
MAGIC = b"PLM1"
SEED = 5_081
GEAR = np.random.Generator(np.random.Philox(key=[SEED, 0])).integers(0, 1 << 32, 256, np.uint64).astype(np.uint32)


class DamagedMedia(ValueError):
    """Stored bytes do not have their digest."""


def payload_of(text: str | None, unit: int = UNIT) -> bytes:
    """The text's UTF-8 bytes, followed by bytes 0 up to a positive multiple of `unit`."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data + bytes(-len(data) % unit if data else unit)


def gear_hashes(data: bytes) -> np.ndarray:
    """At each byte the sum of the last 32 bytes' gear values, each shifted by its distance, modulo 2^32."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # windows of 2, 4, ... 32 bytes from two of half the length
        h[k:] += h[:-k] << np.uint32(k) if k < len(h) else 0
    return h


def cuts(data: bytes, least: int = LEAST, mask_bits: int = MASK_BITS, most: int = MOST) -> list[int]:
    """Ends of the chunks of a payload, the last its length."""
    if len(data) <= least:
        return [len(data)]
    wanted = np.flatnonzero((gear_hashes(data) >> np.uint32(32 - mask_bits)) == 0) + 1
    out, at, n = [], 0, len(data)
    while n - at > least:
        k = np.searchsorted(wanted, at + least)
        end = min(int(wanted[k]) if k < len(wanted) else n, at + most, n)
        out.append(end)
        at = end
    if at < n:
        out.append(n)
    return out


def stored_form(chunks: list[tuple[bytes, bytes]]) -> bytes:
    """chunks: (digest, bytes) in order."""
    head = [MAGIC, struct.pack("<QI", sum(len(c) for _, c in chunks), len(chunks))]
    head += [struct.pack("<I", len(c)) + d for d, c in chunks]
    return b"".join(head + [c for _, c in chunks])


def read_samples(stored: bytes) -> np.ndarray:
    """The samples of a stored form; its digests are verified."""
    if stored[:4] != MAGIC:
        raise DamagedMedia("not a stored form")
    total, count = struct.unpack_from("<QI", stored, 4)
    at, begin = 16, 16 + 20 * count
    for _ in range(count):
        n = struct.unpack_from("<I", stored, at)[0]
        if hashlib.blake2b(stored[begin : begin + n], digest_size=16).digest() != stored[at + 4 : at + 20]:
            raise DamagedMedia("chunk")
        at, begin = at + 20, begin + n
    if begin != len(stored) or begin != 16 + 20 * count + total:
        raise DamagedMedia("length")
    return np.frombuffer(stored, np.uint8, offset=16 + 20 * count)


def feature(samples: np.ndarray) -> str:
    """Mean, root mean square around 128, zero crossings around 128 and the 8 shares of 32 sample values, with fixed digits."""
    values = samples.astype(np.float64)
    sides = samples >= 128
    crossings = int(np.count_nonzero(sides[1:] != sides[:-1]))
    shares = np.bincount(samples >> 5, minlength=8) / len(samples)
    return f"{values.mean():.6f}|{np.sqrt(np.mean((values - 128) ** 2)):.6f}|{crossings}|" + ",".join(f"{s:.6f}" for s in shares)


class PackWriter:
    """Appends chunks to one file of compressed blocks. A chunk's place: (offset of its block, size of the block, offset within)."""

    def __init__(self, folder: str, part: int, attempt: int):
        import zstandard

        self.files, inside = pafs.FileSystem.from_uri(folder)
        self.files.create_dir(inside, recursive=True)
        self.name = f"pack-{part:06d}-{attempt}"
        self.stream = self.files.open_output_stream(f"{inside}/{self.name}")
        self.compress = zstandard.ZstdCompressor(level=3).compress
        self.block, self.size, self.at, self.open_places = [], 0, 0, []

    def add(self, chunk: bytes, place: list) -> None:
        """place is completed when the block is written."""
        place.append(self.size)
        self.open_places.append(place)
        self.block.append(chunk)
        self.size += len(chunk)
        if self.size >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.block:
            data = self.compress(b"".join(self.block))
            self.stream.write(data)
            for place in self.open_places:
                place += [self.at, len(data)]
            self.at += len(data)
            self.block, self.size, self.open_places = [], 0, []

    def close(self) -> None:
        self.flush()
        self.stream.close()


#: One table for what a task knows: a row of kind 'row' names the payload of an id; 'part' is the k-th chunk of a payload;
#: 'chunk' is a chunk's place.
KNOWN = "kind string, id long, media binary, n_bytes long, k int, digest binary, length int, pack string, within long, block long, block_size long"
KNOWN_TYPES = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
KNOWN_NAMES = [x.split()[0] for x in KNOWN.split(", ")]


def _known(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), KNOWN_TYPES)], KNOWN_NAMES)


def store(docs: DataFrame, folder: str, id_col: str, text_col: str, unit: int = UNIT) -> DataFrame:
    """Step 1: writes the packs and returns what the tasks know, partitioned by kind. A task remembers digests, not bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        pack = None
        media_met: set[bytes] = set()
        chunks_met: set[bytes] = set()
        rows: list[tuple] = []
        places: list[tuple[bytes, int, list]] = []
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for doc_id, value in zip(ids, batch.column("text")):
                text = value.as_py()
                payload = payload_of(text, unit)
                media = hashlib.sha256(payload).digest()
                n_bytes = len((text or "").encode("utf-8", "surrogatepass"))
                rows.append(("row", doc_id, media, n_bytes, None, None, None, None, None, None, None))
                if media in media_met:
                    continue
                media_met.add(media)
                at = 0
                for k, end in enumerate(cuts(payload)):
                    chunk = payload[at:end]
                    digest = hashlib.blake2b(chunk, digest_size=16).digest()
                    rows.append(("part", None, media, None, k, digest, end - at, None, None, None, None))
                    if digest not in chunks_met:
                        chunks_met.add(digest)
                        pack = pack or PackWriter(folder, task.partitionId(), task.taskAttemptId())
                        place: list = []
                        pack.add(chunk, place)
                        places.append((digest, end - at, place))
                    at = end
                if len(rows) > 20_000:
                    yield _known(rows)
                    rows = []
                    done = [p for p in places if len(p[2]) == 3]
                    if done:
                        yield _known([("chunk", None, None, None, None, d, n, pack.name, *p) for d, n, p in done])
                        places = places[len(done) :]
        if pack:
            pack.close()
            yield _known([("chunk", None, None, None, None, d, n, pack.name, *p) for d, n, p in places]) if places else pa.RecordBatch.from_arrays([pa.array([], t) for t in KNOWN_TYPES], KNOWN_NAMES)
        if rows:
            yield _known(rows)

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    spark = docs.sparkSession
    path = new_folder(spark, "media-index")
    map_batches(chosen, run, KNOWN).write.option("compression", "zstd").partitionBy("kind").parquet(path)
    index = spark.read.schema(KNOWN).option("basePath", path).parquet(path)
    index.written_to = path
    return index


class PackReader:
    """Blocks of packs, of which the last few are kept."""

    def __init__(self, folder: str, most: int = 48):
        import zstandard

        self.files, self.inside = pafs.FileSystem.from_uri(folder)
        self.blocks: OrderedDict = OrderedDict()
        self.streams: OrderedDict = OrderedDict()
        self.most = most
        self.decompress = zstandard.ZstdDecompressor().decompress

    def block(self, pack: str, at: int, size: int) -> bytes:
        if (pack, at) in self.blocks:
            self.blocks.move_to_end((pack, at))
            return self.blocks[pack, at]
        if pack not in self.streams:
            self.streams[pack] = self.files.open_input_file(f"{self.inside}/{pack}")
            if len(self.streams) > 64:
                self.streams.popitem(last=False)[1].close()
        stream = self.streams[pack]
        stream.seek(at)
        found = self.blocks[pack, at] = self.decompress(stream.read(size), max_output_size=BLOCK + MOST)
        if len(self.blocks) > self.most:
            self.blocks.popitem(last=False)
        return found

    def chunk(self, part: dict) -> bytes:
        block = self.block(part["pack"], part["block"], part["block_size"])
        found = block[part["within"] : part["within"] + part["length"]]
        if hashlib.blake2b(found, digest_size=16).digest() != part["digest"]:
            raise DamagedMedia(f"{part['pack']} at {part['block']}")
        return found


READ = "media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks int"


def read_back(recipes: DataFrame, folder: str, unit: int = UNIT) -> DataFrame:
    """Step 3: recipes (media, home, parts) to one row of facts about each payload, from the stored bytes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = PackReader(folder)
        for batch in batches:
            out = defaultdict(list)
            for media, parts in zip(batch.column("media").to_pylist(), batch.column("parts")):
                chunks = [(p["digest"], reader.chunk(p)) for p in parts.as_py()]
                stored = stored_form(chunks)
                samples = read_samples(stored)
                payload = samples.tobytes()
                digest = hashlib.sha256(payload)
                if digest.digest() != media:
                    raise DamagedMedia(media.hex())
                out["media"].append(media)
                out["payload_bytes"].append(len(payload))
                out["payload_sha256"].append(digest.hexdigest())
                out["tail_crc32"].append(zlib.crc32(payload[-unit:]))
                out["media_bytes"].append(len(stored))
                out["media_sha256"].append(hashlib.sha256(stored).hexdigest())
                out["feature"].append(feature(samples))
                out["n_chunks"].append(len(chunks))
            if out:
                yield pa.RecordBatch.from_pydict(dict(out) | {"n_chunks": pa.array(out["n_chunks"], pa.int32())})

    return map_batches(recipes, run, READ)


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, unit: int = UNIT) -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_chunks) of each row.

    Null and empty texts are a payload of `unit` zeros. Equal texts, repeated rows among them, share one stored form;
    null ids stay null. A payload of any length is cut to chunks of at most MOST bytes. An empty table gives no rows;
    other columns are ignored.
    """
    folder = folder or new_folder(docs.sparkSession, "media")
    index = store(docs, folder, id_col, text_col, unit)
    places = index.where("kind = 'chunk'").groupBy("digest").agg(F.min(F.struct("pack", "block", "within", "block_size")).alias("at"))
    # a payload that several tasks met has the same list from each
    parts = index.where("kind = 'part'").groupBy("media", "k").agg(F.min(F.struct("digest", "length")).alias("chunk")).select("media", "k", "chunk.*")
    placed = parts.join(places, "digest").select("media", F.struct("k", "digest", "length", "at.pack", "at.block", "at.within", "at.block_size").alias("part"))
    recipes = placed.groupBy("media").agg(F.array_sort(F.collect_list("part")).alias("parts"))  # one payload's chunks
    home = F.col("parts")[0]["pack"]
    recipes = recipes.withColumn("home", home).withColumn("first", F.col("parts")[0]["block"])
    count = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = recipes.repartitionByRange(count, "home", "first", "media").sortWithinPartitions("home", "first").select("media", "parts")
    facts = written(read_back(ordered, folder, unit), "media-facts")
    rows = index.where("kind = 'row'").select("id", "media", "n_bytes")
    return rows.join(facts, "media").drop("media")
