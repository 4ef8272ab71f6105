"""Row-local kernels against loops."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from passagelab.functions import kernels as K
from passagelab.functions import text as T


def split_by_loop(text, most, level=0):
    if len(text) <= most or level == 3:
        return [text]
    separator, out, now = ("\n\n", ". ", " ")[level], [], ""
    for part in text.split(separator):
        joined = now + separator + part if now else part
        if len(joined) <= most:
            now = joined
            continue
        if now:
            out.append(now)
        now = "".join(split_by_loop(part, most, level + 1)) if len(part) > most else part
    return out + [now] if now else out


def texts(seed=1, count=120):
    rng = random.Random(seed)
    bits = ["a", "word", "longer-word ", ". ", " ", "\n\n", "\n", "!", "? ", "é", "😀", "  ", ".", "x" * 30]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(count)]
    return made + ["", " ", "\n\n", "\n\nab", "one", "a. b", " nb ", "a" * 40, "a b " * 30, " x ", "tail.\n\n"]


def column(spark, rows, schema, expression):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expression.alias("x")).collect()]


@pytest.mark.parametrize("most", [10, 25, 60])
def test_recursive_split(spark, most):
    rows = [(t,) for t in texts()]
    assert column(spark, rows, "t string", K.recursive_split(F.col("t"), most)) == [split_by_loop(t, most) for (t,) in rows]


def test_true_recursive_pieces_are_short(spark):
    rows = [("aaa bbb. " * 20 + "\n\n" + "c " * 50,)]
    pieces = column(spark, rows, "t string", K.recursive_split(F.col("t"), 20, true_recursive=True))[0]
    assert max(map(len, pieces)) <= 20 and len(pieces) > 10


def windows_by_loop(n, size, overlap):
    out, at = [], 0
    while at < n:
        out.append(at)
        if at + size >= n:
            break
        at += size - overlap
    return out


def children_by_loop(n, size, overlap):
    out, at = [], 0
    while at < n:
        out.append(at)
        at += size - overlap
        if at + size > n and at < n:
            out.append(at)
            break
    return out


def test_window_and_child_starts(spark):
    rows = [("x" * n,) for n in [*range(40), 99, 100, 101, 250]]
    for size, overlap in ((10, 3), (7, 0), (5, 4)):
        assert column(spark, rows, "t string", K.window_starts(F.col("t"), size, overlap)) == [windows_by_loop(len(t), size, overlap) for (t,) in rows]
        assert column(spark, rows, "t string", K.child_starts(F.col("t"), size, overlap)) == [children_by_loop(len(t), size, overlap) for (t,) in rows]
    with pytest.raises(ValueError):
        K.window_starts(F.lit("x"), 5, 5)


def merge_by_loop(items, scores, threshold):
    out, i = [], 0
    while i < len(items):
        if i < len(scores) and i + 1 < len(items) and scores[i] is not None and scores[i] >= threshold:
            out.append(items[i] + " " + items[i + 1])
            i += 2
        else:
            out.append(items[i])
            i += 1
    return out


def group_by_loop(items, bounds, least):
    out, now = [], []
    for i, x in enumerate(items):
        now.append(x)
        if i < len(bounds) and bounds[i] and len(now) >= least:
            out.append(now)
            now = []
    if now:
        if out and len(now) < least:
            out[-1] += now
        else:
            out.append(now)
    return [" ".join(x) for x in out]


def small_by_loop(items, least):
    out, held = [], ""
    for x in items:
        if math.ceil(len(x) / 4) < least:
            held = f"{held} {x}" if held else x
        else:
            out += [held] if held else []
            out.append(x)
            held = ""
    return out + ([held] if held else [])


def test_folds(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(150):
        n = rng.randint(0, 9)
        items = ["w" * rng.randint(1, 30) for _ in range(n)]
        scores = [rng.choice([0.0, 0.5, 0.9, 1.0, None]) for _ in range(max(0, n - 1 + rng.choice([-1, 0, 0, 1])))]
        rows.append((items, scores, [rng.random() < 0.4 for _ in range(max(0, n - 1))]))
    schema = "i array<string>, s array<double>, b array<boolean>"
    assert column(spark, rows, schema, K.merge_pairs(F.col("i"), F.col("s"), 0.9)) == [merge_by_loop(i, s, 0.9) for i, s, _ in rows]
    assert column(spark, rows, schema, K.merge_small(F.col("i"), 4)) == [small_by_loop(i, 4) for i, _, _ in rows]
    for least in (1, 2, 4):
        assert column(spark, rows, schema, K.group_at(F.col("i"), F.col("b"), least)) == [group_by_loop(i, b, least) for i, _, b in rows]


def test_places(spark):
    rows = [("abc abc x abc", ["abc", "x", "abc", "zz", "abc"])]
    first = column(spark, rows, "t string, p array<string>", K.place(F.col("t"), F.col("p")))[0]
    assert [(p.start, p.end, p.located) for p in first] == [(0, 3, True), (8, 9, True), (0, 3, True), (0, 2, False), (0, 3, True)]
    ordered = column(spark, rows, "t string, p array<string>", K.place_in_order(F.col("t"), F.col("p")))[0]
    assert [(p.start, p.located) for p in ordered] == [(0, True), (8, True), (10, True), (13, False), (15, False)]


def test_samples(spark):
    rows = [(n,) for n in range(60)]
    for most in (1, 8, 10):
        got = column(spark, rows, "n int", K.sample_places(F.col("n"), most))
        assert got == [list(range(n)) if n <= most else [math.floor(i * (n / most)) for i in range(most)] for (n,) in rows]


def test_percentile_and_median(spark):
    rng = random.Random(2)
    rows = [([rng.choice([0.1, 0.2, 0.5, rng.random()]) for _ in range(n)],) for n in range(25)]

    def by_hand(values, p):
        ordered = sorted(values)
        at = p / 100 * (len(values) - 1)
        low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
        return low + (high - low) * (at - math.floor(at))

    assert column(spark, rows, "v array<double>", T.percentile(F.col("v"), 85)) == [by_hand(v, 85) if v else 0.0 for (v,) in rows]
    assert column(spark, [([0.0, 3.0, 1.0, 2.0, 4.0],), ([0.0],), ([],)], "v array<double>", T.upper_median(F.col("v"), 12.0)) == [3.0, 12.0, 12.0]


def test_scalars(spark):
    rows = [(t,) for t in texts()]
    space = r"[\s ﻿]"
    trimmed = lambda t: re.sub(rf"\A{space}+|{space}+\Z", "", t)
    assert column(spark, rows, "t string", T.estimate_tokens(F.col("t"))) == [math.ceil(len(t) / 4) for (t,) in rows]
    assert column(spark, rows, "t string", T.trim(F.col("t"))) == [trimmed(t) for (t,) in rows]
    assert column(spark, rows, "t string", T.sentences(F.col("t"))) == [[s for s in (trimmed(x) for x in re.split(rf"(?<=[.!?]){space}+", t)) if s] for (t,) in rows]
    assert column(spark, rows, "t string", T.total_words(F.col("t"))) == [len(re.split(rf"{space}+", t.lower())) for (t,) in rows]
    assert column(spark, [("the Cat, a dog the, I",)], "t string", T.useful_words(F.col("t"))) == [3]
    assert column(spark, [("abcdef",)], "t string", T.preview(F.col("t"), 3)) == ["abc…"]
    assert column(spark, [(1.005,), (2.5,), (None,), (-0.125,)], "v double", T.to_fixed(F.col("v"), 2)) == ["1.00", "2.50", None, "-0.13"]
    pair = [([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 2.0]), ([1.0, 2.0], [2.0, 1.0])]
    assert [round(x, 9) for x in column(spark, pair, "a array<double>, b array<double>", T.cosine(F.col("a"), F.col("b")))] == [1.0, 0.0, 0.8]


def test_answers_of_models(spark):
    said = [("scores: [0.5, 1]",), ("none",), ("[1, 2",), ("[0.1.2]",), ('x {"score": 0.7} {"score": 1}',), ("",)]
    assert column(spark, said, "t string", T.number_list(F.col("t")))[:3] == [[0.5, 1.0], None, None]
    objects = column(spark, said, "t string", T.first_object(F.col("t"), "struct<score: double>"))
    assert objects[4].score == 0.7 and objects[1] is None
    assert column(spark, [('a ["x", "y"] b ["z"]',)], "t string", T.first_list(F.col("t"), "array<string>")) == [["x", "y"]]


def test_pieces_are_looked_for_from_their_place(spark):
    """Long texts of many sentences: a search that counts characters from the beginning for each sentence takes minutes for these."""
    import time

    from passagelab.functions.judges import HeuristicJudge
    from passagelab.operators.strategies import Agentic

    text = " ".join(f"Sentence number {k} says é." for k in range(60_000))
    frame = spark.createDataFrame([(1, text), (2, "One. One. Two."), (3, "")], "doc_id long, text string")
    began = time.time()
    done = {r.doc_id: r.chunks for r in Agentic().apply(frame, HeuristicJudge()).collect()}
    assert time.time() - began < 40
    assert len(done[1]) == 60_000 and all(text[c.start : c.end] == c.text and c.located for c in done[1])
    assert [(c.start, c.end) for c in done[2]] == [(0, 4), (5, 9), (10, 14)] and done[3] == []


def test_searches_in_order(spark):
    rows = [(1, "aé b aé", ["aé", "aé", "zz", "b", "", None]), (2, None, ["x"]), (3, "x", None), (4, "x", [])]
    frame = spark.createDataFrame(rows, "k int, t string, p array<string>")
    found = {r.k: r for r in frame.select("k", K.place_in_order(F.col("t"), F.col("p")).alias("v"), K.contained(F.col("t"), F.col("p")).alias("c")).collect()}
    assert [tuple(x)[1:] for x in found[1].v] == [(0, 2, True), (5, 7, True), (7, 9, False), (9, 10, False), (0, 0, True), (0, None, None)]
    assert found[1].c == [True, True, False, True, True, None]
    assert [tuple(x) for x in found[2].v] == [("x", 0, 1, None)] and found[2].c == [None] and found[3].v is None and found[3].c is None and found[4].v == []
