"""Token ids as length-delimited binary records with a separate offset index.

A file holds records one after another. A record is

    length   8 bytes, little-endian, of the data
    check    4 bytes, little-endian: masked CRC-32 of the length's 8 bytes
    data     8 bytes doc_id, then the ids as little-endian unsigned integers of 2 bytes
             (vocabularies up to 65,536 ids) or 4
    check    4 bytes, little-endian: masked CRC-32 of the data

Masking turns a CRC right by 15 bits and adds a constant, so that a checksum of data that holds
checksums stays sound. The index beside each file holds the offset of every record (8 bytes
each), by which readers can take records in any order. A doc_id that is null is stored as the smallest long.
"""

from __future__ import annotations

import random
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagelab.llm.common import map_batches, new_folder, slices
from passagelab.llm.tokens import default_path, encoder

END_ID = 0
NULL_ID = -(1 << 63)
#: Fixed value: what masking adds.
MASK_DELTA = 0xA282EAD8
MANIFEST = "part int, path string, records long, ids long"


class DamagedRecord(ValueError):
    """A checksum or length does not fit."""


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(data: bytes) -> bytes:
    length = struct.pack("<Q", len(data))
    return b"".join((length, struct.pack("<I", masked(length)), data, struct.pack("<I", masked(data))))


def read_record(stream, where: str = "") -> bytes | None:
    """The next record's data; None at the end of the stream."""
    head = stream.read(12)
    if not head:
        return None
    if len(head) < 12 or masked(head[:8]) != struct.unpack_from("<I", head, 8)[0]:
        raise DamagedRecord(f"length {where}")
    n = struct.unpack_from("<Q", head)[0]
    body = stream.read(n + 4)
    if len(body) < n + 4 or masked(body[:n]) != struct.unpack_from("<I", body, n)[0]:
        raise DamagedRecord(f"data {where}")
    return body[:n]


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def write_records(
    docs: DataFrame,
    folder: str | None = None,
    tokenizer_path: str | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
    width: int = 2,
    partitions: int | None = None,
) -> tuple[str, DataFrame]:
    """Writes the ids of all rows in ascending order of id; returns the folder and the list of files.

    The rows are range-partitioned by id and each partition becomes one file; null ids come first,
    and rows that repeat an id keep together, in the order of their texts. A file appears under its name only when
    it is whole, and a task that runs again writes the same bytes. width: bytes for an id.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "records")
    path = tokenizer_path or default_path()
    kind = {2: "<u2", 4: "<u4"}[width]
    largest = (1 << 8 * width) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        files, inside = _open(folder)
        files.create_dir(inside, recursive=True)
        name, scratch = f"{inside}/part-{part:06d}.tok", f"{inside}/.part-{part:06d}-{attempt}"
        encode, records, total, at, offsets = encoder(path).encode, 0, 0, 0, []
        end = np.array([end_id], "<u4").tobytes()
        with files.open_output_stream(scratch) as out:
            for batch in batches:
                ids = batch.column("id").to_pylist()
                for first, texts in slices(batch, "text"):
                    for k, encoded in enumerate(encode([t or "" for t in texts])):
                        tokens = np.frombuffer(encoded + end, "<u4")
                        if width == 2 and tokens.max() > largest:
                            raise ValueError("an id does not fit into 2 bytes; use width=4")
                        doc_id = ids[first + k]
                        record = frame(struct.pack("<q", NULL_ID if doc_id is None else doc_id) + tokens.astype(kind).tobytes())
                        out.write(record)
                        offsets.append(at)
                        at, records, total = at + len(record), records + 1, total + len(tokens)
        if records:
            with files.open_output_stream(f"{scratch}.idx") as out:
                out.write(np.array(offsets, "<u8").tobytes())
            files.move(f"{scratch}.idx", f"{name}.idx")
            files.move(scratch, name)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [f"{folder}/part-{part:06d}.tok"], "records": [records], "ids": [total]})
        else:
            files.delete_file(scratch)

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    count = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = chosen.repartitionByRange(count, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    manifest = map_batches(ordered, run, MANIFEST).collect()  # one row for each file
    return folder, spark.createDataFrame(sorted(manifest), MANIFEST)


def read_records(spark: SparkSession, manifest: DataFrame, width: int = 2) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, part, record) of each record, read from the files in order.

    start: the ids of all records before it. ids_crc32: of the ids as little-endian unsigned 32-bit integers.
    """
    files = sorted(manifest.collect())  # one row for each file
    kind, jobs, before = {2: "<u2", 4: "<u4"}[width], [], 0
    for part, path, records, ids in files:
        jobs.append((part, path, records, before))
        before += ids
    listed = spark.createDataFrame(jobs, "part int, path string, records long, before long")
    if jobs:
        listed = listed.repartition(len(jobs), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for job in batch.to_pylist():
                yield from _read_file(job, kind)

    return map_batches(listed, run, "doc_id long, start long, n_tokens long, ids_crc32 long, part int, record long")


def _read_file(job: dict, kind: str) -> Iterator[pa.RecordBatch]:
    files, inside = _open(job["path"])
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "part", "record"]
    kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64()]
    at, rows = job["before"], []
    with files.open_input_stream(inside, buffer_size=1 << 20) as stream:
        for k in range(job["records"]):
            data = read_record(stream, f"{k} of {job['path']}")
            if data is None:
                raise DamagedRecord(f"{job['path']} ends after {k} of {job['records']} records")
            doc_id = struct.unpack_from("<q", data)[0]
            ids = np.frombuffer(data, kind, offset=8)
            rows.append((None if doc_id == NULL_ID else doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), job["part"], k))
            at += len(ids)
            if len(rows) == 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)


def shuffled_records(path: str, seed: int, width: int = 2) -> Iterator[tuple[int | None, np.ndarray]]:
    """A file's records as (doc_id, ids) in a random order that the seed fixes, through the offset index."""
    files, inside = _open(path)
    with files.open_input_stream(f"{inside}.idx") as stream:
        offsets = np.frombuffer(stream.read(), "<u8").tolist()
    random.Random(seed).shuffle(offsets)
    with files.open_input_file(inside) as stream:
        for at in offsets:
            stream.seek(at)
            data = read_record(stream, f"at {at} of {path}")
            doc_id = struct.unpack_from("<q", data)[0]
            yield None if doc_id == NULL_ID else doc_id, np.frombuffer(data, {2: "<u2", 4: "<u4"}[width], offset=8)
