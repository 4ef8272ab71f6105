"""Benchmark decontamination by a distributed positional inverted index. DataFrame functions only.

A window is `window` consecutive words of a benchmark item (an item with fewer is one window).
One pass over the texts stores the postings (term, row, position) of all benchmark words in all documents. Their frequencies are counted
from the index, and each window's two rarest places are its anchors. The lists of a window's two anchors are joined within blocks of
positions: where their distance is that of the window, the offset-adjusted lists intersect, and there the lists of all
other words of the item are intersected too, which leaves the exact phrases; where they merely lie
within `near` words of each other, the item is a proximity match.

No step pairs documents with each other, and a hot document, item or term is only as large as its matches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from passagelab.llm.common import forget, free_name, small, written

WINDOW, NEAR = 13, 26
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of what is no word, as Java and as DuckDB read it.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Begins the term that stands after a document's last word; no word has it.
END = "\0"


def split_words(text):
    """The words of a text column, with an empty one at either end where the text begins or ends with a gap."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAPS)


def word_list(text):
    return F.filter(split_words(text), lambda w: w != "")


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(number, item, words): the items with words, each text of an id once."""
    words = items.select(F.col(id_col).cast("string").alias("item"), word_list(F.col(text_col).cast("string")).alias("words"))
    return words.where(F.size("words") > 0).distinct().withColumn("number", F.monotonically_increasing_id())


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The index: (term, row, pos, doc_id, text_hash) of each occurrence of a term in docs (doc_id, text_hash, text).

    After each document's words stands its end: the term END and the number of empty ends that the words have, at the place of their number.
    """
    words = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_hash", split_words(F.col("text")).alias("words"))
    empty = F.element_at("words", 1).eqNullSafe("").cast("int") + F.element_at("words", -1).eqNullSafe("").cast("int")
    placed = words.select("row", "doc_id", "text_hash", F.posexplode(F.concat("words", F.array(F.concat(F.lit(END), empty.cast("string"))))).alias("pos", "term"))
    held = terms.select("term").union(docs.sparkSession.createDataFrame([(f"{END}{k}",) for k in range(3)], "term string"))
    return placed.join(small(held, terms.count()), "term")


def documents_of(index: DataFrame) -> DataFrame:
    """(row, doc_id, text_hash, n_words) of every document, from the index."""
    words = F.greatest(F.lit(0), F.col("pos") - F.substring("term", 2, 1).cast("int")).cast("long")
    return index.where(F.col("term").startswith(END)).select("row", "doc_id", "text_hash", words.alias("n_words"))


def anchors(found: DataFrame, counted: DataFrame, window: int = WINDOW) -> DataFrame:
    """(number, at1, term1, at2, term2): of each window whose words the corpus has all, the two rarest places in its item (ties: the earlier), distinct.

    Places count from 0. A window of one word has one place twice.
    """
    places = found.select("number", F.posexplode("words").alias("at", "term")).join(small(counted, counted.count()), "term", "left")
    whole = places.groupBy("number").agg(F.array_sort(F.collect_list(F.struct("at", "n", "term"))).alias("places"))  # of one item
    starts = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("places") - (window - 1)))).alias("s")
    cut = whole.select("number", "places", starts).select("number", F.slice("places", F.col("s"), F.lit(window)).alias("own")).where("forall(own, p -> p.n is not null)")
    ranked = cut.select("number", F.array_sort(F.transform("own", lambda p: F.struct(p["n"].alias("n"), p["at"].alias("at"), p["term"].alias("term")))).alias("by"))
    second = F.element_at("by", F.least(F.lit(2), F.size("by")))
    first = F.element_at("by", 1)
    return ranked.select("number", first["at"].alias("at1"), first["term"].alias("term1"), second["at"].alias("at2"), second["term"].alias("term2")).distinct()


def together(index: DataFrame, pairs: DataFrame, near: int) -> DataFrame:
    """(row, term1, term2, p1, p2): where the terms of a pair stand within `near` words of each other. The two lists are joined within blocks of places."""
    few = pairs.count()
    one = index.select("row", F.col("pos").alias("p1"), F.col("term").alias("term1")).join(small(pairs, few), "term1")
    two = index.select("row", F.col("pos").alias("p2"), F.col("term").alias("term2")).join(small(pairs, few), "term2")
    left = one.withColumn("block", F.explode(F.expr(f"sequence(p1 div {near} - 1, p1 div {near} + 1)")))
    right = two.withColumn("block", F.expr(f"p2 div {near}"))
    return left.join(right, ["row", "term1", "term2", "block"]).where(F.abs(F.col("p1") - F.col("p2")).between(1, near)).select("row", "term1", "term2", "p1", "p2")


def phrases(index: DataFrame, found: DataFrame, candidates: DataFrame, window: int) -> DataFrame:
    """(row, number, start, length): the runs of an item's words, each as long as a window or longer, in documents.

    candidates (row, number, offset): where the two rarest lists meet once offsets are adjusted. There the lists of all other words of the item
    are intersected too: what is left of them are places of the item that the document has at this offset, and runs of these.
    """
    places = found.select("number", F.size("words").alias("words"), F.posexplode("words").alias("at", "term"))
    wanted = candidates.join(small(places, places.count()), "number").withColumn("pos", F.col("offset") + F.col("at")).where("pos >= 0")
    rows = candidates.select("row").distinct()
    held = index.select("row", "term", "pos").join(small(rows, rows.count()), "row", "left_semi")
    met = wanted.join(held, ["row", "term", "pos"], "left_semi")
    own = Window.partitionBy("row", "number", "offset").orderBy("at")
    runs = met.withColumn("run", F.col("at") - F.row_number().over(own)).groupBy("row", "number", "offset", "words", "run").agg(F.min("pos").alias("start"), F.count("*").alias("length"))
    return runs.where(F.col("length") >= F.least(F.lit(window), F.col("words"))).select("row", "number", "start", "length")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, near: int = NEAR) -> tuple[DataFrame, DataFrame]:
    """(documents, hits): documents (row, doc_id, text_hash, n_words) of all docs (doc_id, text_hash, text), and hits (row, n_hit, n_near, items array<string>) of those with a match.

    The caller forgets documents, which is read from the index, when it is done. See `report` for odd rows. near must be at least `window`.
    """
    found = written(item_words(items), "items")
    index = written(postings(docs, found.select(F.explode("words").alias("term")).distinct()), "postings")
    counted = index.where(~F.col("term").startswith(END)).groupBy("term").agg(F.count("*").alias("n"))
    places = written(anchors(found, counted, window), "anchors")
    pairs = places.where("at1 != at2")
    terms = pairs.select("term1", "term2").distinct()
    met = together(index, terms, near).join(small(pairs, pairs.count()), ["term1", "term2"])
    met = written(met.groupBy("row", "number", F.when(F.expr("p2 - p1 = at2 - at1"), F.col("p1") - F.col("at1")).alias("offset")).agg(F.count("*").alias("n")), "met")
    single = places.where("at1 = at2").select(F.col("term1").alias("term"), "number", "at1")
    alone = index.select("row", "term", "pos").join(small(single, single.count()), "term").select("row", "number", (F.col("pos") - F.col("at1")).alias("offset"))
    candidates = written(met.where("offset is not null").select("row", "number", "offset").union(alone).distinct(), "candidates")
    exact = written(phrases(index, found, candidates, window), "exact")

    named = found.select("number", "item")
    which = exact.select("row", "number").distinct().join(small(named, named.count()), "number").select("row", "item").distinct()
    close = met.select("row", "number").distinct().join(small(named, named.count()), "number").select("row", "item").distinct()
    around = close.join(which, (close["row"] == which["row"]) & close["item"].eqNullSafe(which["item"]), "left_anti").groupBy("row").agg(F.count("item").alias("n_near"))

    spans = exact.groupBy("row", "start").agg(F.max("length").alias("length"))
    earlier = Window.partitionBy("row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    covered = spans.withColumn("reached", F.coalesce(F.max(end).over(earlier), F.lit(-1)))
    covered = covered.groupBy("row").agg(F.sum(F.greatest(F.lit(0), end - F.greatest("start", "reached"))).alias("n_hit"))
    out = written(covered.join(which.groupBy("row").agg(F.collect_set("item").alias("items")), "row", "full").join(around, "row", "full"), "hits")
    rows = written(documents_of(index), "documents")
    forget(found, index, places, met, candidates, exact)
    return rows, out


def with_hashes(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text): rows that repeat an id are told apart by the hash of their text."""
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20, near: int = NEAR) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near.

    n_hit: words inside an occurrence of a window. n_near: items of which no window occurs, but of one of whose windows the two rarest
    words stand within `near` words of each other. Null and empty texts have no
    words and are clean; null and empty items have no windows; items that repeat an id or a text
    count once for each id, and those with a null id find words but count for no item. Repeated rows
    get equal results. Other columns are ignored.
    """
    rows, found = decontaminate(with_hashes(docs), items, window, near)
    none = F.array().cast("array<string>")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    listed = F.coalesce("items", none)
    facts = written(
        found.select(
            "row",
            hit.alias("n_hit"),
            F.size(listed).cast("long").alias("n_items"),
            F.sha2(F.array_join(F.array_sort(listed), ",").cast("binary"), 256).alias("items_sha256"),
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        ),
        "facts",
    )
    forget(found)
    joined = rows.join(small(facts, facts.count()), "row", "left")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
        ((hit > 0) & (share * hit >= F.col("n_words"))).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """documents without those in which a window of an item occurs, however long they are; all others stay unchanged, with all their columns, under any name.

    Null and empty texts, and all documents if there are no items, are clean. Rows that repeat an id are told apart by their texts; rows that repeat both stay or
    go together, as do ties; null ids are ids like any other. An empty table stays empty.
    """
    rows, found = decontaminate(with_hashes(docs), items, window)
    hit = found.where("n_hit > 0").select("row")
    id_name, hash_name = free_name(docs, "id"), free_name(docs, "hash")
    gone = written(rows.join(small(hit, hit.count()), "row", "left_semi").select(F.col("doc_id").alias(id_name), F.col("text_hash").alias(hash_name)).distinct(), "gone")
    forget(rows, found)
    same = docs["doc_id"].eqNullSafe(F.col(id_name)) & (F.xxhash64(docs["text"].cast("string")) == F.col(hash_name))
    return docs.join(small(gone, gone.count()), same, "left_anti")


ORACLE = r"""
WITH i AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
v AS (SELECT DISTINCT item, list_slice(ws, s, s + 12) AS own FROM (SELECT item, ws, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS s FROM i WHERE len(ws) > 0)),
w AS (SELECT item, array_to_string(own, ' ') AS phrase, len(own) AS n FROM v),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
sizes AS (SELECT DISTINCT n FROM w),
g AS (SELECT doc_id, s, n, array_to_string(list_slice(ws, s, s + n - 1), ' ') AS phrase FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, sizes WHERE len(ws) >= n)),
m AS (SELECT g.doc_id, g.s, g.n, w.item FROM g JOIN w ON g.phrase = w.phrase AND g.n = w.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY doc_id),
p AS (SELECT doc_id, unnest(ws) AS term, unnest(range(1, len(ws) + 1)) AS pos FROM d WHERE len(ws) > 0),
c AS (SELECT term, count(*) AS f FROM p GROUP BY term),
e AS (SELECT item, own, unnest(own) AS term, unnest(range(1, len(own) + 1)) AS pl FROM v),
r AS (SELECT e.item, e.own, e.term, row_number() OVER (PARTITION BY e.item, e.own ORDER BY c.f, e.pl) AS k, count(c.f) OVER (PARTITION BY e.item, e.own) AS held FROM e LEFT JOIN c USING (term)),
a AS (SELECT DISTINCT x.item, x.term AS t1, y.term AS t2 FROM r x JOIN r y ON x.item = y.item AND x.own = y.own AND x.k = 1 AND y.k = 2 WHERE x.held = len(x.own)),
q AS (SELECT DISTINCT t1, t2 FROM a),
z AS (SELECT DISTINCT x.doc_id, q.t1, q.t2 FROM q JOIN p x ON x.term = q.t1 JOIN p y ON y.doc_id = x.doc_id AND y.term = q.t2 AND abs(x.pos - y.pos) BETWEEN 1 AND 26),
near AS (SELECT doc_id, count(*) AS n_near FROM (SELECT DISTINCT z.doc_id, a.item FROM z JOIN a USING (t1, t2) EXCEPT SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items, sha256(coalesce(t.items, '')) AS items_sha256,
  (coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.ws)) AS contaminated, coalesce(near.n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id) LEFT JOIN near USING (doc_id)
"""
