import hashlib
import random
import zlib

import pytest

from passagelab.llm import media_chunks as M
from tests.llm.odd import documents, empty, odd


def payload(text):
    data = (text or "").encode()
    return data + b"\0" * ((-len(data)) % 64 if data else 64)


@pytest.mark.parametrize("make", [documents, odd])
def test_round_trip(spark, make):
    docs = make(spark)
    found = M.media_column(docs).collect()
    key = lambda i, s: (i is None, i or 0, s)
    wanted = sorted((key(r.doc_id, hashlib.sha256(payload(r.text)).hexdigest()), len((r.text or "").encode()), len(payload(r.text)), zlib.crc32(payload(r.text)[-64:])) for r in docs.collect())
    assert sorted((key(r.id, r.payload_sha256), r.n_bytes, r.payload_bytes, r.tail_crc32) for r in found) == wanted
    by_payload = {}
    for r in found:
        assert by_payload.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)


def test_empty(spark):
    assert M.media_column(empty(spark)).count() == 0


def test_rolling_hash_is_that_of_the_last_32_bytes():
    data = random.Random(1).randbytes(500)
    for n in (1, 2, 5, 31, 33, 500):
        got = M.gear_hashes(data[:n])
        for i in range(n):
            assert got[i] == sum(int(M.GEAR[data[i - k]]) << k for k in range(min(32, i + 1))) % 2**32


def test_cuts_follow_content():
    rng = random.Random(2)
    data = rng.randbytes(200_000)
    ends = M.cuts(data)
    sizes = [b - a for a, b in zip([0, *ends], ends)]
    assert ends[-1] == len(data) and all(M.LEAST <= s <= M.MOST for s in sizes[:-1]) and len(sizes) > 50
    chunks = lambda d: {d[a:b] for a, b in zip([0, *M.cuts(d)], M.cuts(d))}
    shifted = rng.randbytes(777) + data
    assert len(chunks(data) & chunks(shifted)) > 0.9 * len(chunks(data))
    assert M.cuts(b"\0" * 64) == [64] and M.cuts(b"\0" * 100_000)[-1] == 100_000


def test_damage_is_found():
    chunks = [(hashlib.blake2b(c, digest_size=16).digest(), c) for c in (b"abc", b"defg")]
    stored = M.stored_form(chunks)
    assert M.read_samples(stored).tobytes() == b"abcdefg"
    for k in range(len(stored)):
        with pytest.raises((M.DamagedMedia, Exception)):
            M.read_samples(stored[:k] + bytes([stored[k] ^ 1]) + stored[k + 1 :])


def cut_by_hand(data):
    """Chunks by the rule itself, byte by byte."""
    out, at = [], 0
    while len(data) - at > M.LEAST:
        end = at + M.LEAST
        while end < min(len(data), at + M.MOST):
            h = sum(int(M.GEAR[data[end - 1 - k]]) << k for k in range(min(32, end))) % 2**32
            if h >> (32 - M.MASK_BITS) == 0:
                break
            end += 1
        out.append(data[at:end])
        at = end
    return out + ([data[at:]] if at < len(data) else [])


def stored_by_hand(data):
    chunks = cut_by_hand(data)
    head = b"PLM1" + len(data).to_bytes(8, "little") + len(chunks).to_bytes(4, "little")
    return head + b"".join(len(c).to_bytes(4, "little") + hashlib.blake2b(c, digest_size=16).digest() for c in chunks) + data


def feature_by_hand(data):
    mean = sum(data) / len(data)
    root = (sum((x - 128) ** 2 for x in data) / len(data)) ** 0.5
    crossings = sum((a >= 128) != (b >= 128) for a, b in zip(data, data[1:]))
    shares = [sum(x // 32 == k for x in data) / len(data) for k in range(8)]
    return f"{mean:.6f}|{root:.6f}|{crossings}|" + ",".join(f"{s:.6f}" for s in shares)


def test_stored_forms_and_features_by_hand(spark):
    rng = random.Random(5)
    shared = "".join(rng.choice("abcdefg hijkl\n") for _ in range(6000))
    texts = [shared, shared, "x" + shared, shared + "é" * 50, "", None, "short", "\U0001f600" * 900]
    found = {r.id: r for r in M.media_column(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, text in enumerate(texts):
        data = payload(text)
        stored = stored_by_hand(data)
        assert (found[k].media_bytes, found[k].media_sha256, found[k].feature) == (len(stored), hashlib.sha256(stored).hexdigest(), feature_by_hand(data)), k
        assert found[k].n_chunks == len(cut_by_hand(data))


def test_chunks_are_stored_and_indexed_once(spark, tmp_path):
    rng = random.Random(6)
    shared = "".join(rng.choice("abcdefg hijkl\n") for _ in range(60_000))
    texts = [shared, shared, "before " + shared, shared + " after", "other"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    folder = f"file://{tmp_path}/packs"
    rows = M.store(docs, folder, "doc_id", "text").collect()
    every = [hashlib.blake2b(c, digest_size=16).digest() for t in texts for c in cut_by_hand(payload(t))]
    placed = [bytes(r.digest) for r in rows if r.kind == "chunk"]
    assert sorted(placed) == sorted(set(every)) and len(placed) < 0.5 * len(every)
    assert len({bytes(r.media) for r in rows if r.kind == "part"}) == 4 and sum(r.kind == "row" for r in rows) == 5
    import zstandard

    held = b"".join(zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(p.read_bytes()) for p in (tmp_path / "packs").glob("pack-*"))
    assert len(held) == sum(len(c) for c in {c for t in texts for c in cut_by_hand(payload(t))})
