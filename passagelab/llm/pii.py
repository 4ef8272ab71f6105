"""Personal data: exact seed entities, and more identifiers by bootstrapped contexts.

Seeds are the contract's four kinds, found by their patterns and checks. A candidate is a token with a digit or an at
sign that no seed touches; an instance is its text in lower case. Its context patterns are the
words around it: (two words before), (word before, word after), (two words after), and, more general, one word before or after together
with the shape of the token, in which runs of letters and of digits are one sign each.

Spark scores the graph of patterns and instances in rounds. A pattern's confidence in a kind is the
share of its occurrences that are known instances of the kind, damped by its support; an instance
joins a kind when the noisy-or of the confident patterns that it meets is high enough. Patterns of
the last round then mark the candidates that they surround: few patterns are sent to the tasks, many are joined to the candidates' contexts
by Spark, with the same result. Occurrences are aggregated before each shuffle, so a common context costs one row for each task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagelab.llm.common import forget, map_batches, small, written

KINDS = ("email", "ip", "card", "phone")

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin where digits begin, which the look-behind says at no cost.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(found: str) -> str:
    return "".join(c for c in found if "0" <= c <= "9")


def _good_ip(found: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in found.split("."))


def _good_card(found: str) -> bool:
    digits = _digits(found)
    return 12 <= len(digits) <= 19 and luhn(digits)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of EMAIL: it is tried where the characters before an at sign begin, not at every word."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        match = EMAIL.match(text, start) if start < at else None
        if match:
            free = match.end()
            yield match.span()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the seeds in code points, in this order."""
    text = text or ""
    found = [(a, 0, b) for a, b in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if _good_ip(m[0])]
    found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if _good_card(m[0])]
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found)


TELLING = re.compile(r"[0-9@]")
EDGE = "\"'()[]{}<>,;:.!?"
#: Characters on either side that are looked at first for two words; more if they do not hold them.
NEAR = 100
LETTERS, DIGIT_RUN = re.compile(r"[^\W\d_]+"), re.compile(r"[0-9]+")


def _words(text: str) -> list[str]:
    return [w for w in (re.sub(r"\W+", "", x) for x in text.lower().split()) if w]


def _before(text: str, start: int) -> list[str]:
    """The last two words before a place, or as many as there are; no word is cut."""
    size = NEAR
    while True:
        begin = max(0, start - size)
        if begin:
            while begin < start and not text[begin - 1].isspace():
                begin += 1
        found = _words(text[begin:start])
        if len(found) >= 2 or start - size <= 0:
            return found[-2:]
        size *= 4


def _after(text: str, end: int) -> list[str]:
    """The first two words after a place, or as many as there are; no word is cut."""
    size = NEAR
    while True:
        stop = min(len(text), end + size)
        if stop < len(text):
            while stop > end and not text[stop].isspace():
                stop -= 1
        found = _words(text[end:stop])
        if len(found) >= 2 or end + size >= len(text):
            return found[:2]
        size *= 4


def shape(found: str) -> str:
    return DIGIT_RUN.sub("9", LETTERS.sub("a", found))


def contexts(text: str, start: int, end: int) -> list[str]:
    """The context patterns of a span, each once."""
    before, after = _before(text, start), _after(text, end)
    form = shape(text[start:end])
    out = []
    if len(before) == 2:
        out.append(f"{before[0]} {before[1]} _")
    if before and after:
        out.append(f"{before[-1]} _ {after[0]}")
    if len(after) == 2:
        out.append(f"_ {after[0]} {after[1]}")
    if before:
        out.append(f"{before[-1]} _ {{{form}}}")
    if after:
        out.append(f"{{{form}}} _ {after[0]}")
    return out


def candidates(text: str, taken: list[tuple[int, int]], least: int = 5) -> Iterator[tuple[int, int]]:
    """Tokens of `least` characters or more with a digit or an at sign, without marks at their edges, that touch no taken span."""
    end, k = 0, 0
    for telling in TELLING.finditer(text):
        if telling.start() < end:
            continue
        start = telling.start()
        while start > 0 and not text[start - 1].isspace() and start - 1 >= end:
            start -= 1
        end = telling.end()
        while end < len(text) and not text[end].isspace():
            end += 1
        a, b = start, end
        while a < b and text[a] in EDGE:
            a += 1
        while b > a and text[b - 1] in EDGE:
            b -= 1
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if b - a >= least and not (k < len(taken) and taken[k][0] < b):
            yield a, b


def normal(found: str) -> str:
    return found.lower().replace(" ", "").replace("-", "")


SPANS = "array<struct<start: long, end: long, kind: string, base: boolean>>"
SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_())]))


def occurrences(docs: DataFrame) -> DataFrame:
    """(instance, pattern, kind, n): how often a seed (with its kind) or a candidate (kind null) stands in a context.

    docs: (text string). Counted in each task first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, int] = {}
        for batch in batches:
            for value in batch.column("text"):
                text = value.as_py()
                if not text or not TELLING.search(text):
                    continue
                seeds = base_spans(text)
                taken = _merged([(a, b) for a, _, b in seeds])
                for a, kind, b in seeds:
                    for p in contexts(text, a, b):
                        key = (normal(text[a:b]), p, KINDS[kind])
                        held[key] = held.get(key, 0) + 1
                for a, b in candidates(text, taken):
                    for p in contexts(text, a, b):
                        key = (normal(text[a:b]), p, None)
                        held[key] = held.get(key, 0) + 1
                if len(held) > 100_000:
                    yield _counts(held)
                    held = {}
        if held:
            yield _counts(held)

    return map_batches(docs, run, "instance string, pattern string, kind string, n long")


def _counts(held: dict[tuple, int]) -> pa.RecordBatch:
    instances, patterns, kinds = zip(*held)
    return pa.RecordBatch.from_pydict({"instance": pa.array(instances, pa.string()), "pattern": pa.array(patterns, pa.string()), "kind": pa.array(kinds, pa.string()), "n": pa.array(held.values(), pa.int64())})


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def bootstrap(docs: DataFrame, rounds: int = 3, pattern_confidence: float = 0.6, instance_confidence: float = 0.8, support: int = 5, damping: float = 1.0, most_patterns: int = 20_000) -> DataFrame:
    """(pattern, kind, confidence) of the confident patterns after the last round.

    confidence = known / (all + damping), over distinct instances; a pattern needs `support` of them, and
    among its kinds the most confident counts (ties: the kind that sorts first). An instance is admitted at
    1 - product(1 - confidence) >= instance_confidence over the distinct patterns that surround it, and stays
    admitted. Up to `most_patterns` patterns are broadcast.
    """
    graph = written(occurrences(docs).groupBy("instance", "pattern", "kind").agg(F.sum("n").alias("n")), "graph")
    known = graph.where("kind is not null").select("instance", "kind").distinct()
    edges = graph.groupBy("instance", "pattern").agg(F.sum("n").alias("n"))
    kept: list[DataFrame] = []
    scored = None
    for _ in range(rounds):
        shares = edges.join(known, "instance", "left").groupBy("pattern", "kind").agg(F.count_distinct("instance").alias("n"))
        shares = shares.groupBy("pattern").agg(F.sum("n").alias("all"), F.max(F.when(F.col("kind").isNotNull(), F.struct("n", F.struct(F.expr("transform(split(kind, ''), c -> -ascii(c))").alias("order"), "kind").alias("named")))).alias("best"))
        fair = F.col("best.n") / (F.col("all") + damping)
        following = shares.where((F.col("all") >= support) & (fair >= pattern_confidence)).select("pattern", F.col("best.named.kind").alias("kind"), F.round(fair, 9).alias("confidence"))
        if scored is not None:
            kept.append(scored)
        scored = written(following, "patterns")
        met = edges.join(small(scored, scored.count(), most_patterns), "pattern")
        belief = met.groupBy("instance", "kind").agg(F.round(1 - F.product(1 - F.col("confidence")), 9).alias("belief"))
        admitted = belief.where(F.col("belief") >= instance_confidence).select("instance", "kind").join(known.select("instance").distinct(), "instance", "left_anti")
        known = written(known.union(admitted), "known")
        kept.append(known)
    forget(graph, *kept)
    return scored


def spans_of(docs: DataFrame, patterns: list[tuple[str, str, float]], id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, keep: str | None = None) -> DataFrame:
    """(id, spans) of each row, and the column `keep` (long): all seeds, and the candidates whose patterns reach `least` together for one kind.

    The kind is `found_` and the name of the seeds' kind. Null and empty texts have no spans. Every row gives one row,
    with repeated and null ids too.
    """
    confidence = {p: (k, c) for p, k, c in patterns}

    kept = [keep] if keep else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{"start": a, "end": b, "kind": k, "base": base} for a, b, k, base in find(x.as_py(), confidence, least)] for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(batch.column(c) for c in kept), pa.array(rows, SPAN_TYPE)], ["id", *kept, "spans"])

    chosen = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *kept)
    return map_batches(chosen, run, f"id long, {''.join(f'{c} long, ' for c in kept)}spans {SPANS}")


def find(text: str | None, confidence: dict[str, tuple[str, float]], least: float = 0.8) -> list[tuple[int, int, str, bool]]:
    text = text or ""
    seeds = base_spans(text)
    out = [(a, k, b, KINDS[k], True) for a, k, b in seeds]
    if confidence:
        for a, b in candidates(text, _merged([(a, b) for a, _, b in seeds])):
            doubt: dict[str, float] = {}
            for kind, c in {p: confidence[p] for p in contexts(text, a, b) if p in confidence}.values():
                doubt[kind] = doubt.get(kind, 1.0) * (1 - c)
            if doubt:
                kind = min(doubt, key=lambda k: (round(doubt[k], 9), k))
                if round(1 - doubt[kind], 9) >= least:
                    out.append((a, len(KINDS) + KINDS.index(kind), b, f"found_{kind}", False))
    return [(a, b, kind, base) for a, _, b, kind, base in sorted(out)]


def joined_spans(docs: DataFrame, scored: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """spans_of() for any number of patterns: Spark joins the candidates' contexts with them, by row (id and hash of the text) and place."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, starts, ends, patterns = [], [], [], []
            for k, value in enumerate(batch.column("text")):
                own = value.as_py()
                if own and TELLING.search(own):
                    for a, b in candidates(own, _merged([(a, b) for a, _, b in base_spans(own)])):
                        for p in contexts(own, a, b):
                            which.append(k)
                            starts.append(a)
                            ends.append(b)
                            patterns.append(p)
            at = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("text_hash").take(at), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(patterns, pa.string())], ["id", "text_hash", "start", "end", "pattern"])

    met = map_batches(rows, run, "id long, text_hash long, start long, end long, pattern string").distinct().join(scored, "pattern")
    place = ["id", "text_hash", "start", "end"]
    doubt = met.groupBy(*place, "kind").agg(F.round(F.product(1 - F.col("confidence")), 9).alias("doubt"))
    best = doubt.groupBy(*place).agg(F.min(F.struct("doubt", "kind")).alias("best")).where(F.round(1 - F.col("best.doubt"), 9) >= least)
    found = best.groupBy("id", "text_hash").agg(F.collect_list(F.struct("start", "end", F.concat(F.lit("found_"), F.col("best.kind")).alias("kind"), F.lit(False).alias("base"))).alias("more"))  # of one text
    seeds = spans_of(rows, [], "id", "text", least, keep="text_hash")
    same = seeds["id"].eqNullSafe(found["id"]) & (seeds["text_hash"] == found["text_hash"])
    both = seeds.join(found, same, "left").select(seeds["id"], F.concat("spans", F.coalesce("more", F.array().cast(SPANS))).alias("spans"))
    order = " ".join(f"when '{k}' then {n}" for n, k in enumerate([*KINDS, *(f"found_{k}" for k in KINDS)]))
    ordered = F.expr(f"transform(array_sort(transform(spans, s -> struct(s.start as a, case s.kind {order} end as k, s.end as b, s as span))), x -> x.span)")
    return both.select("id", ordered.cast(SPANS).alias("spans"))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_patterns: int = 20_000, **settings) -> DataFrame:
    """(id, spans) by seeds and bootstrapped patterns.

    Up to `most_patterns` patterns are sent to the tasks, more are joined there; the result is the same. Rows that repeat an id, and null ids, are
    rows like any other; ties go to the kind that sorts first. An empty table gives no rows; extra columns are ignored.
    """
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    scored = bootstrap(texts, most_patterns=most_patterns, **settings)
    least = settings.get("instance_confidence", 0.8)
    if scored.count() > most_patterns:
        return joined_spans(docs, scored, id_col, text_col, least)
    found = scored.collect()
    forget(scored)
    return spans_of(docs, [tuple(r) for r in found], id_col, text_col, least)


def digest(docs: DataFrame) -> DataFrame:
    """Per document the counts of the base kinds, the digest of their spans, and all spans."""
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    listed = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    base = F.expr(listed.format("filter(spans, s -> s.base)"))
    return detect(docs).select(F.col("id").alias("doc_id"), *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.expr(listed.format("spans")).alias("spans"))
