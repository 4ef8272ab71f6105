import hashlib
import random
import re

import pytest

from passagelab.llm.decontamination import keep_clean, report
from tests.llm.odd import documents, empty, odd

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, doc_id string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_hand(docs, items, n=13):
    windows = {(i, tuple(w[k : k + n])) for i, t in items for w in [words(t)] for k in range(max(1, len(w) - n + 1)) if w}
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for item, phrase in windows:
            for k in range(len(w) - len(phrase) + 1):
                if tuple(w[k : k + len(phrase)]) == phrase:
                    hit.update(range(k, k + len(phrase)))
                    found.add(item)
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc is None, doc or 0, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out)


def got(frame):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in frame.collect())


def noise(seed, count, vocabulary, most):
    rng = random.Random(seed)
    return [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, most))) for _ in range(count)]


@pytest.mark.parametrize("window", [13, 3])
def test_matches_brute_force(spark, window):
    vocabulary = ["a", "B", "cé", "d4", "É", "the", "the", "the"]
    docs = [(k, t) for k, t in enumerate(noise(1, 60, vocabulary, 60))] + [(100, None), (101, ""), (102, "..."), (None, "a b a"), (7, "-a, b! a"), (7, "-a, b! a")]
    items = [(k, t) for k, t in enumerate(noise(2, 12, vocabulary, 20))] + [(50, None), (51, "?"), (52, "a"), (53, "the the"), (None, "d4 d4"), (52, "b a"), (52, "a"), (54, docs[3][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    found = report(frame, spark.createDataFrame([(*i, "x") for i in items], ITEMS), window=window)
    assert got(found) == by_hand(docs, items, window)


def test_table(spark):
    docs = documents(spark)
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    pairs = [(r.item_id, r.text) for r in items.collect()]
    wanted = by_hand([(r.doc_id, r.text) for r in docs.collect()], pairs)
    assert any(w[-1] for w in wanted)
    assert got(report(docs, items)) == wanted
    kept = keep_clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(w[1] for w in wanted if not w[3])


def test_odd_rows(spark):
    items = [(1, "quick brown fox jumps over the lazy dog near the river bank the quick"), (2, "ein anderer satz")]
    frame = spark.createDataFrame([(*i, "x") for i in items], ITEMS)
    rows = [(r.doc_id, r.text) for r in odd(spark).collect()]
    assert got(report(odd(spark), frame)) == by_hand(rows, items)
    assert len(keep_clean(odd(spark), frame).collect()) == 12 - 2  # the copy-pasted sentence twice, and the short one
    assert report(empty(spark), frame).count() == 0
    nothing = spark.createDataFrame([], ITEMS)
    assert got(report(odd(spark), nothing)) == by_hand(rows, [])


def test_proximity(spark):
    docs = [(1, "alpha x x x omega"), (2, "omega alpha"), (3, "alpha " + "x " * 40 + "omega"), (4, "alpha beta omega")]
    items = [(9, "alpha beta omega", "x")]
    found = {r.doc_id: (r.n_hit, r.n_near) for r in report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)).collect()}
    assert found == {1: (0, 0), 2: (0, 0), 3: (0, 0), 4: (3, 0)}  # the rarest are beta and the earlier of alpha and omega


def test_no_python_on_the_executors(spark, capsys):
    report(documents(spark), spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def near_by_hand(docs, items, n=13, near=26):
    """Per document the number of items without a window in it of one of whose windows the two rarest words stand near each other."""
    texts = [words(t) for _, t in docs]
    counts = {}
    for w in texts:
        for x in w:
            counts[x] = counts.get(x, 0) + 1
    out = []
    for w in texts:
        found = set()
        exact = set()
        for item, t in items:
            own = words(t)
            for k in range(max(1, len(own) - n + 1)) if own else ():
                window = own[k : k + n]
                if any(w[p : p + len(window)] == window for p in range(len(w))):
                    exact.add(str(item))
                if len(window) > 1 and all(x in counts for x in window):
                    a, b = sorted(range(len(window)), key=lambda p: (counts[window[p]], p))[:2]
                    if any(x == window[a] and y == window[b] and 1 <= abs(p - q) <= near for p, x in enumerate(w) for q, y in enumerate(w)):
                        found.add(str(item))
        out.append(len(found - exact))
    return out


def test_proximity_matches_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 18)))) for k in range(10)]
    docs = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 90)))) for k in range(25)] + [(30, items[0][1]), (31, "w1 w1 w1")]
    found = {r.doc_id: r.n_near for r in report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(*i, "x") for i in items], ITEMS)).collect()}
    assert [found[i] for i, _ in docs] == near_by_hand(docs, items) and sum(found.values()) > 10
