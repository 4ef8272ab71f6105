import random

import corpus_pipeline
from passagelab.llm import shingle_dedup
from passagelab.llm.blocks import MET
from passagelab.llm.shingle_dedup import keep_one_similar
from passagelab.llm.simhash_dedup import fingerprint
from tests.llm.odd import empty, odd


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()


def by_hand(docs):
    up = {i: i for i, _ in docs}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    sets = [(i, grams(t)) for i, t in docs]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a == b or len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return {root(i) for i in up}


def test_every_pair_at_jaccard_meets(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(400)]
    docs = []
    for _ in range(15):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((6, 30, 90, 200)))]
        for changes in (0, 1, 2, 3, 5, 8):
            words = list(base)
            for at in rng.sample(range(len(words)), min(changes, len(words) // 25 + 1)):
                words[at] = rng.choice(vocabulary)
            docs.append((len(docs), " ".join(words + [rng.choice(vocabulary)] * (changes % 2))))
    rng.shuffle(docs)
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    wanted = by_hand(sorted(docs))
    assert len(wanted) < len({t for _, t in docs})
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, "").collect()} == wanted


def test_odd_rows(spark):
    assert keep_one_similar(empty(spark)).count() == 0
    kept = keep_one_similar(odd(spark))
    assert kept.columns == odd(spark).columns and 5 in {r.doc_id for r in kept.collect()}


def test_rows_that_share_an_id_are_told_apart(spark):
    a, b = " ".join(f"a{k}" for k in range(20)), " ".join(f"b{k}" for k in range(20))
    docs = spark.createDataFrame([(1, a, 5), (2, b, 6), (2, a, 7), (2, b, 6), (3, b, 8), (None, a, 9), (None, "alone here", 10)], "doc_id long, text string, text_hash int")
    assert sorted((r.doc_id or 0, r.text, r.text_hash) for r in keep_one_similar(docs).collect()) == [(0, "alone here", 10), (1, a, 5), (2, b, 6)]


def test_many_documents_that_share_a_passage(spark):
    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(60))
    docs = [(k, " ".join(rng.choice("abcdefghij") + str(rng.randrange(10**6)) for _ in range(30)) + " " + passage) for k in range(400)]
    docs += [(1000 + k, f"{docs[k][1]} end") for k in range(50)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id for r in keep_one_similar(frame).collect()} == set(range(400))


def test_simhash_links_near_copies_without_the_exact_search(spark, monkeypatch):
    """Copies whose fingerprints differ in a bit or two go by SimHash alone; a text of few other shingles whose fingerprint is close too stays, by the exact check."""
    rng = random.Random(9)
    vocabulary = [f"w{k}" for k in range(400)]
    docs, pairs = [], 0
    while pairs < 3:
        words = [rng.choice(vocabulary) for _ in range(400)]
        other = [*words[:-1], "changed"]
        if 0 < (fingerprint(" ".join(words), 5) ^ fingerprint(" ".join(other), 5)).bit_count() <= 2:
            docs += [" ".join(words), " ".join(other)]
            pairs += 1
    line = "one two three four five " * 40
    docs += [f"{line} a b c", f"{line} x y z"]  # the repeats decide every bit
    assert (fingerprint(docs[-1], 5) ^ fingerprint(docs[-2], 5)).bit_count() <= 2
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(shingle_dedup, "alike_blocks", lambda docs, *_: spark.createDataFrame([], MET))
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, frame, "").collect()} == {0, 2, 4, 6, 7}
