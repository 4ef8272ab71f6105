import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from passagelab.llm import token_records as R
from passagelab.llm.packing import Packer, pack, tiers
from passagelab.llm.tokens import Encoder, default_path
from tests.llm.odd import documents, empty, odd


@pytest.fixture(scope="module")
def ids_of():
    tokenizer = Tokenizer.from_file(default_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_memory_gives_the_library_s_ids(ids_of):
    texts = ["", " ", "a  b", "It's we'll THEY'RE x'y", "\n\n a\t\t b ", "don't  \n", "naïve déjà 😀 漢字 \x1c \x85   ²³ ½", "<|endoftext|> x<|endoftext|>", "a_b __ 12 3.4e5", " ſK ǅ", "z" * 3000, "a b ", "a \n b", "a\n b\n", "a \u200bb \x1c c \x85d", "x\u00a0 y", "it 's 're ' s", "  ", "\n a", "é è\u3000ê", "a\nb c\n\nd e"]
    import random

    rng = random.Random(1)
    texts += ["".join(rng.choice(["a", "be", " ", " ", " ", "\n", "'s", "1", ".", "é", "\t", "\xa0", "\x1f", "漢"]) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    encoder = Encoder(default_path())
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == [ids_of(t) for t in texts]


def test_memory_is_bounded(ids_of, monkeypatch):
    monkeypatch.setattr("passagelab.llm.tokens.MEMORY", 5)
    encoder = Encoder(default_path())
    texts = [f"some words {k} and others {k * 7}" for k in range(20)]
    for t in texts:
        assert np.frombuffer(encoder.encode([t])[0], "<u4").tolist() == ids_of(t)
        assert len(encoder.memory) <= 20


@pytest.mark.parametrize("make", [documents, odd])
def test_records_read_back(spark, ids_of, make):
    docs = make(spark)
    folder, manifest = R.write_records(docs, partitions=3)
    found = sorted((r.part, r.record, r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in R.read_records(spark, manifest).collect())
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    assert [f[2] for f in found] == [r.doc_id for r in rows]
    at = 0
    for (_, _, _, start, n, check), r in zip(found, rows):
        ids = ids_of(r.text) + [0]
        assert (start, n, check) == (at, len(ids), crc(ids))
        at += n
    path = manifest.collect()[0].path
    one = list(R.shuffled_records(path, 7))
    assert [i for i, _ in one] == [i for i, _ in R.shuffled_records(path, 7)]
    assert sorted(str(i) for i, _ in one) == sorted(str(f[2]) for f in found if f[0] == found[0][0])


def test_records_of_nothing(spark):
    _, manifest = R.write_records(empty(spark))
    assert manifest.count() == 0 and R.read_records(spark, manifest).count() == 0


def test_damage_is_found(tmp_path):
    record = R.frame(b"some data")
    (tmp_path / "x").write_bytes(record)
    with (tmp_path / "x").open("rb") as f:
        assert R.read_record(f) == b"some data" and R.read_record(f) is None
    for k in range(len(record)):
        (tmp_path / "x").write_bytes(record[:k] + bytes([record[k] ^ 1]) + record[k + 1 :])
        with (tmp_path / "x").open("rb") as f, pytest.raises(R.DamagedRecord):
            R.read_record(f)
    assert struct.unpack("<Q", record[:8]) == (9,)


def check_packing(rows, docs, ids_of, window=2048):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for r in docs:
        if r.doc_id is None or sum(x.doc_id == r.doc_id for x in docs) > 1:
            continue
        ids, at = ids_of(r.text) + [1], 0
        for p in sorted(by_doc[r.doc_id], key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), crc(ids[at : at + p.length]))
            at += p.length
        assert at == len(ids)
    padding = 0
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= window and own[0].padded_length == (at if at & (at - 1) == 0 else window)
        padding += own[0].padded_length - at
    assert sum(r.length for r in rows) == sum(len(ids_of(r.text)) + 1 for r in docs)
    return padding


def test_packing(spark, ids_of):
    docs = documents(spark)
    rows = pack(docs).collect()
    assert check_packing(rows, docs.collect(), ids_of) <= 2048
    groups = defaultdict(set)
    for r in rows:
        groups[r.step_group].add((r.tier, r.sequence_id))
    assert all(len({t for t, _ in g}) == 1 and sum(t for t, _ in g) <= 16 * 2048 for g in groups.values())
    full = {t: [g for g in groups.values() if {x for x, _ in g} == {t}] for t in tiers()}
    for t, own in full.items():  # of each tier all steps but one have equal work
        assert sum(sum(x for x, _ in g) < 16 * 2048 for g in own) <= 1
    lengths = defaultdict(int)
    for r in rows:
        lengths[r.tier, r.sequence_id] += r.length
    assert sum(t != n for (t, _), n in lengths.items()) <= 1 and {t for t, _ in lengths} == {2048, 1024, 512, 256}
    check_packing(pack(odd(spark)).collect(), odd(spark).collect(), ids_of)
    assert pack(empty(spark)).count() == 0


def test_tiers_and_gaps():
    assert tiers(16, 4) == [16, 8, 4]
    with pytest.raises(ValueError):
        tiers(12, 4)
    packer = Packer(16, 4, most_waiting=1)
    done = []
    for k, n in enumerate((9, 3, 4, 40, 1, 7)):
        done += packer.add(k, np.arange(n))
    done += packer.finish()
    sizes = [sum(len(p[2]) for p in s) for s in done]
    assert sum(sizes) == 64 and sizes == [4, 16, 16, 4, 8, 16]
    assert sorted((p[0], p[1] + k) for s in done for p in s for k in range(len(p[2]))) == [(d, k) for d, n in enumerate((9, 3, 4, 40, 1, 7)) for k in range(n)]


def test_each_tier_packs_its_own_windows():
    rng = np.random.default_rng(3)
    packer, filled = Packer(), []
    for k in range(6000):
        filled += packer.add(k, np.arange(int(rng.lognormal(5.5, 1.2)) + 1))
    sizes = [sum(len(p[2]) for p in s) for s in filled]
    assert set(sizes) == set(tiers()) and min(sizes.count(t) for t in tiers()) > 100
    for size, own in zip(sizes, filled):
        assert len(own[0][2]) > size // 2 or size == 256  # its own tier's piece opens a window, shorter ones fill its gap
        assert all(len(p[2]) <= len(own[0][2]) or p is own[-1] for p in own)
    assert any(len(p[2]) <= 256 for size, own in zip(sizes, filled) if size == 2048 for p in own[1:])
    left = list(packer.finish())
    assert sum(sum(len(p[2]) for p in s) not in tiers() for s in left) <= 1
