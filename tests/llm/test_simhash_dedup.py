from collections import Counter

import xxhash

from passagelab.llm.components import components
from passagelab.llm.simhash_dedup import fingerprint, keep_one, links, near_duplicates
from tests.llm.odd import documents, empty, odd


def by_hand(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    """id to smallest reachable id; prints: (id, fingerprint)."""
    up = {i: i for i, _ in prints}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in prints:
        for j, b in prints:
            if i < j and (a ^ b).bit_count() <= 2 and root(i) != root(j):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {i: root(i) for i, _ in prints}


def test_matches_brute_force(spark):
    docs = documents(spark)
    prints = [(r.doc_id, by_hand(r.text)) for r in docs.collect()]
    for crowd in (64, 1):
        found = near_duplicates(docs, crowd=crowd).collect()
        assert {r.id: r.fp % 2**64 for r in found} == dict(prints)
        assert {r.id: r.component for r in found} == classes(prints)


def test_crowded_variants_lose_no_link(spark):
    import random

    rng = random.Random(5)
    base = rng.getrandbits(64)
    values = {base}
    for _ in range(300):
        x = rng.choice(sorted(values))
        values.add(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    values |= {rng.getrandbits(64) for _ in range(50)}
    signed = sorted(v - 2**64 if v >> 63 else v for v in values)
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    for crowd in (1, 8, 1000):
        found = {r.node: r.component for r in components(links(nodes, crowd)).collect()}
        wanted = classes([(v, v % 2**64) for v in signed])
        assert {v: found.get(v, v) for v in signed} == wanted


def test_odd_rows(spark):
    found = near_duplicates(odd(spark)).collect()
    assert len(found) == 12
    zero = [r for r in found if r.fp == 0]
    assert len(zero) == 4 and {r.component for r in zero} == {2}  # null, empty and blank texts link
    assert sorted((r.id is None, r.id) for r in zero) == sorted((i is None, i) for i in (2, 3, 4, None))
    assert near_duplicates(empty(spark)).count() == 0


def test_keep_one_of_each_group(spark):
    kept = keep_one(odd(spark), shingle=3)
    assert kept.columns == odd(spark).columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[6] == 1 and ids[2] == 1 and 3 not in ids and 4 not in ids
    assert ids[None] == 1  # the null text is in a group with ids; the other row of a null id is alone
    docs = documents(spark)
    classes_of = {r.component for r in near_duplicates(docs, shingle=5).collect()}
    assert {r.doc_id for r in keep_one(docs).collect()} == classes_of


def test_rows_that_share_an_id_are_told_apart(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "h i j k l m n"), (2, "a b c d e f g"), (2, "h i j k l m n"), (3, "h i j k l m n")], "doc_id long, text string")
    assert sorted(tuple(r) for r in keep_one(docs).collect()) == [(1, "a b c d e f g"), (2, "h i j k l m n")]


def test_components(spark):
    import random

    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1300)] + [(7, 7), (2000, 2000)] + [(5000, k) for k in range(5001, 5300)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(up[a], up[b])
            if up[a] != low or up[b] != low:
                up[a] = up[b] = low
                changed = True
    assert found == up
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_edges():
    assert fingerprint(None) == fingerprint(" \n") == 0
    assert fingerprint("One  two") == xxhash.xxh64_intdigest(b"one two", 42)
    assert fingerprint("a b c d") == by_hand("a b c d")
    assert fingerprint("É A b c") == by_hand("É A b c")
