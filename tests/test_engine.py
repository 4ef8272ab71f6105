import hashlib
import math

import pytest
from pyspark.sql import functions as F

from passagelab.functions.judges import FunctionJudge, HeuristicJudge, Provider, ReplayJudge, http_judge, price
from passagelab.operators import evaluate as E
from passagelab.operators import passages as P
from passagelab.operators import retrieve as R
from passagelab.operators import strategies as S
from passagelab.plans.compare import run_all, run_cached, run_profile, unused
from passagelab.schema import STRUCTURE
from passagelab.sources import exports, html, pdf
from passagelab.streaming import stream
from tests.test_kernels import children_by_loop, split_by_loop

DOCS = [
    (1, "First sentence here. Second sentence there! Third one?\n\nA new paragraph with more words. And its end."),
    (2, "short"),
    (3, ""),
    (4, "word " * 900 + "\n\n" + "other " * 700),
]


def docs(spark, rows=DOCS, headings=None):
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("structure", F.lit(None).cast(STRUCTURE))
    if headings is not None:
        frame = frame.withColumn("structure", F.from_json(F.lit(headings), STRUCTURE))
    return frame


def answers(f):
    """A judge that answers by a function of the prompt."""
    return FunctionJudge(function=lambda prompt, most: {"text": f(prompt), "input_tokens": 1, "output_tokens": 2})


def test_every_strategy_runs(spark):
    for kind in S.REGISTRY.values():
        rows = S.chunk_documents(docs(spark), kind()).collect()
        assert {r.doc_id for r in rows} >= {1, 4}, kind
        for r in rows:
            assert r.tokens == math.ceil(len(r.text) / 4) and r.end == r.start + len(r.text)
            assert not r.located or dict(DOCS)[r.doc_id][r.start : r.end] == r.text


def test_settings_are_checked():
    with pytest.raises(ValueError):
        S.make("parent_child", child_tokens=32, overlap=32)
    with pytest.raises(ValueError):
        S.make("sliding_window_summary", size=300, overlap=300)
    with pytest.raises(ValueError):
        S.make("kamradt_semantic", percentile=100)
    with pytest.raises(ValueError):
        S.make("late", nonsense=1)
    with pytest.raises(KeyError):
        S.make("nothing")
    with pytest.raises(ValueError):
        S.register(S.Late)


def test_parent_child_matches_a_loop(spark):
    strategy = S.ParentChild(parent_tokens=256, child_tokens=64, overlap=8)
    rows = S.chunk_documents(docs(spark), strategy).orderBy("doc_id", "index").collect()
    for doc_id, text in DOCS:
        own, index = [r for r in rows if r.doc_id == doc_id], 0
        for parent in split_by_loop(text, 1024):
            starts = children_by_loop(len(parent), 256, 32)
            assert (own[index].text, own[index].children) == (parent, [index + 1 + k for k in range(len(starts))])
            for k, s in enumerate(starts):
                child = own[index + 1 + k]
                assert (child.text, child.parent_index) == (parent[s : s + 256], index)
            index += 1 + len(starts)
        assert index == len(own)
    big = R.small_to_big(S.chunk_documents(docs(spark), strategy)).where("parent_index is not null").collect()
    assert all(r.text in r.parent_text for r in big)


def test_kamradt_places_follow_a_cursor(spark):
    text = "One two. One two. Three four. One two."
    rows = S.chunk_documents(docs(spark, [(1, text)]), S.KamradtSemantic(percentile=99, min_sentences=1)).orderBy("index").collect()
    at = 0
    for r in rows:
        assert r.start >= at and (not r.located or text[r.start : r.end] == r.text)
        at = r.end


def test_structure(spark):
    text = "preamble\nOne\nsmall\nTwo\n" + "x y " * 200 + "\nThree\nend"
    heads = [(1, "One"), (2, "Two"), (4, "Three")]
    listed = [{"level": n, "text": t, "start": text.index(t), "end": text.index(t) + len(t)} for n, t in heads]
    import json

    frame = docs(spark, [(1, text)], json.dumps({"headings": listed}))
    rows = S.chunk_documents(frame, S.StructureAware(max_tokens=512, min_tokens=20, levels=3)).orderBy("index").collect()
    assert [r.text for r in rows] == ["One\nsmall", text[text.index("Two") :].strip()]
    assert {r.strategy_id for r in rows} == {"structure_aware"}
    split = answers(lambda p: '["left part", "right part"]')
    rows = S.chunk_documents(frame, S.StructureAware(max_tokens=128, min_tokens=20, levels=3), split).orderBy("index").collect()
    assert [r.text for r in rows] == ["One\nsmall", "left part", "right part"]
    plain = S.StructureAware().apply(docs(spark, [(1, text)]), HeuristicJudge()).collect()[0]
    assert (plain.strategy_id, plain.requested_strategy_id) == ("recursive_semantic", "structure_aware")
    assert P.select_heading(frame, 1).collect()[0].text == text[text.index("Two") : text.index("Three")]
    rebased = P.select_span(frame, 9, 30, rebase=True).collect()[0]
    assert [(h.text, h.start) for h in rebased.structure.headings] == [("One", 0), ("Two", text.index("Two") - 9)]


def test_answers_that_cannot_be_read(spark):
    pairs = docs(spark, [(1, "Aaa bbb ccc. Ddd eee fff. Ggg hhh iii.")])
    half = S.KamradtSemantic(min_sentences=1).apply(pairs, answers(lambda p: "no scores")).collect()[0]
    assert len(half.chunks) == 3  # all similarities are one half, so every gap is a boundary
    short = S.KamradtSemantic(min_sentences=1).apply(pairs, answers(lambda p: "[0.1]")).collect()[0]
    assert len(short.chunks) == 2
    with pytest.raises(Exception, match="cannot be read"):
        S.KamradtSemantic().apply(pairs, answers(lambda p: "[0.1.2, 3]")).collect()
    for broken in ("nothing", "[{broken", ""):
        assert S.Late().apply(pairs, answers(lambda p, b=broken: b)).collect()[0].chunks == []
        assert S.Agentic().apply(pairs, answers(lambda p, b=broken: b)).collect()[0].chunks == []
    late = S.Late().apply(pairs, answers(lambda p: 'Sure: [{"chunk": "Ddd eee fff.", "contextDependencies": ["x"]}, {"chunk": "not there"}]')).collect()[0].chunks
    assert [(c.start, c.located, c.context_dependencies) for c in late] == [(13, True, ["x"]), (0, False, None)]
    agentic = S.Agentic().apply(pairs, answers(lambda p: '[{"proposition": "P", "sourceSpan": [3, 9]}, {"proposition": "Qq"}]')).collect()[0].chunks
    assert [(c.start, c.end) for c in agentic] == [(3, 9), (0, 2)]


def test_weakest_sentence_cuts(spark):
    text = "Aaaaaaaaaaaa bbb. Cccccccccccc ddd. Eeeeeeeeeeee fff. Gggggggggggg hhh."

    def say(index):
        return answers(lambda p: f'{{"index": {index}}}' if "index" in p else "[0.1]")

    cut = lambda judge: [c.text for c in S.RecursiveSemantic().apply(docs(spark, [(1, text)]), judge).collect()[0].chunks]
    assert cut(say(1)) == ["Aaaaaaaaaaaa bbb.", "Cccccccccccc ddd. Eeeeeeeeeeee fff. Gggggggggggg hhh."]
    assert cut(say(99))[1] == "Gggggggggggg hhh." and cut(say(-5))[0] == "Aaaaaaaaaaaa bbb."
    assert cut(say('"what"')) == ["Aaaaaaaaaaaa bbb. Cccccccccccc ddd.", "Eeeeeeeeeeee fff. Gggggggggggg hhh."]
    assert cut(HeuristicJudge()) == [text]


def test_failed_windows_leave_gaps(spark):
    def say(prompt, most):
        if "BAD" in prompt:
            raise RuntimeError("refused")
        return {"text": "  a summary \n"}

    text = "g" * 300 + "BAD" + "h" * 300
    chunks = S.SlidingSummary(size=200, overlap=0).apply(docs(spark, [(1, text)]), FunctionJudge(function=say)).collect()[0]
    assert [c["index"] for c in chunks.chunks] == [0, 2, 3] and chunks.api_calls == 4
    assert chunks.chunks[0].summary == "a summary" and chunks.chunks[0].embedding_input == "a summary\n\n" + "g" * 200


def test_replay(spark):
    prompt = "hello"
    table = spark.createDataFrame([(hashlib.sha256(b"hello").hexdigest(), "said", 3, 4, None)], "prompt_sha256 string, text string, input_tokens int, output_tokens int, error string")
    asked = spark.createDataFrame([(prompt,), ("other",), (None,)], "p string")
    rows = {r.p: r.o for r in ReplayJudge(answers=table).complete(asked, "p", "o", 10).collect()}
    assert rows["hello"].text == "said" and rows["other"].error == "no answer" and rows[None] is None


def test_providers():
    assert price("gemini", "unheard-of") == (0.10, 0.40) and price("anthropic", "x") == (3.0, 15.0)
    for kind in ("anthropic", "gemini", "ollama"):
        url, _, body = Provider(kind, "qwen3-8b").request("p", 7)
        assert url.startswith("http") and "7" in str(body) and (kind != "ollama" or body["think"] is False)
    assert Provider("anthropic", "m").answer({"content": [{"text": "a"}, {"text": "b"}], "usage": {"input_tokens": 2, "output_tokens": 1}}) == {"text": "ab", "input_tokens": 2, "output_tokens": 1}
    assert Provider("gemini", "m").answer({})["text"] == "" and Provider("ollama", "m").answer({"message": {"content": "c"}})["text"] == "c"
    assert http_judge(Provider("ollama", "m")).usd == (0.0, 0.0)
    with pytest.raises(ValueError):
        Provider("nobody", "m").request("p", 1)


def test_evaluation(spark):
    runs = run_all(docs(spark), [S.SlidingSummary(), S.KamradtSemantic()])
    rows = E.evaluate(runs).collect()
    assert len(rows) == 8
    for r in rows:
        assert 0 <= r.token_efficiency <= 1 and abs(r.composite - (r.avg_self_containedness + r.avg_boundary_coherence + r.token_efficiency) / 3) < 1e-12
    empty = next(r for r in rows if r.doc_id == 3 and r.strategy_id == "sliding_window_summary")
    assert (empty.chunk_count, empty.avg_tokens, empty.composite) == (0, 0.0, 0.0)
    failed = E.evaluate(runs.withColumn("error", F.lit("broke"))).where("doc_id = 4").collect()
    assert all(r.composite == 0 and r.chunk_count > 0 and r.avg_tokens == 0 for r in failed)
    known = E.evaluate(runs, precision=spark.createDataFrame([(1, "kamradt_semantic", 1.0)], "doc_id long, strategy_id string, retrieval_precision double"))
    r = known.where("retrieval_precision is not null").collect()[0]
    assert abs(r.composite - (r.avg_self_containedness + r.avg_boundary_coherence + r.token_efficiency + 1) / 4) < 1e-12
    ranked = E.ranked(E.by_strategy(runs)).collect()
    assert sorted(x.rank for x in ranked) == [1, 2] and sum(x.top for x in ranked) == 1
    assert E.radar(E.by_strategy(runs), ["kamradt_semantic", "late"]).count() == 5


def test_precision(spark):
    ranks = spark.createDataFrame([(q, "s", i, i + 1) for q in (1, 2, 3) for i in range(5 if q < 3 else 2)], "query_id long, strategy_id string, chunk_index int, rank int")
    judged = [(1, "s", 0, True, 1), (1, "s", 0, False, 2), (1, "s", 1, True, 1), (1, "s", 2, True, 1), (2, "s", 0, True, 1), (2, "s", 1, True, 1), (3, "s", 0, True, 1), (3, "s", 1, True, 1)]
    latest = R.latest_judgments(spark.createDataFrame(judged, "query_id long, strategy_id string, chunk_index int, relevant boolean, ts long"))
    assert {r.query_id: r.precision for r in R.precision_at(ranks, latest, 5).collect()} == {1: 2 / 5, 2: None, 3: None}
    assert {r.query_id: r.precision for r in R.precision_at(ranks, latest, 1).collect()} == {1: 0.0, 2: 1.0, 3: 1.0}
    assert R.judged_only(ranks, latest).count() == 7


def test_queries(spark):
    chunks = S.chunk_documents(docs(spark), S.ParentChild())
    queries = spark.createDataFrame([(1, "second sentence"), (2, "other")], "query_id long, query string")
    ranked = R.run_query(queries, chunks, R.HashingEmbedder(32), k=3).collect()
    assert ranked and all(r.rank <= 3 for r in ranked)
    by_score = sorted((r for r in ranked if (r.query_id, r.doc_id) == (2, 4)), key=lambda r: r["rank"])
    assert [r.score for r in by_score] == sorted((r.score for r in by_score), reverse=True)
    assert R.candidates(chunks, children_only=True).where("children is not null").count() == 0
    judge = answers(lambda p: '[{"index": 1, "score": 0.9}, {"index": 999, "score": 0.8}, {"index": 0, "score": 0.1}]')
    said = R.run_query(queries.limit(1), chunks, judge=judge, k=3).where("doc_id = 4").collect()
    assert sorted((r.chunk_index, r["rank"]) for r in said) == [(0, 3), (1, 1)]

    class Broken:
        def embed(self, *args):
            raise RuntimeError("no model")

    assert R.run_query(queries.limit(1), chunks, Broken(), judge).count() > 0
    with pytest.raises(RuntimeError):
        R.run_query(queries, chunks, Broken())
    with pytest.raises(ValueError):
        R.run_query(spark.createDataFrame([(1, "  ")], "query_id long, query string"), chunks, R.HashingEmbedder())


def test_model_embedder(spark):
    out = R.FunctionEmbedder(lambda: lambda batch: [[len(t), 1.0] for t in batch]).embed(spark.createDataFrame([("abc",)], "t string"), "t", "v").collect()
    assert out[0].v == [3.0, 1.0]


def test_html(spark):
    page = "<html><head><title>t</title></head><body><h1> A &amp; <b>B</b> </h1>x<script>no</script><!-- c --><H3>C</h3>y<noscript>n</noscript><h2>open"
    text, headings = html.walk(page)
    assert text == " A & B xCyopen"
    assert [(h["level"], h["text"], h["start"], h["end"]) for h in headings] == [(1, "A & B", 0, 5), (3, "C", 8, 9), (2, "open", 10, 14)]
    frame = spark.createDataFrame([(1, page), (2, None)], "doc_id long, html string")
    rows = html.with_structure(frame).orderBy("doc_id").collect()
    assert rows[0].text == text and rows[0].structure.pages is None and rows[1].text == ""


def test_ranking_against_every_pair(spark, monkeypatch):
    """Groups of all sizes that are cut by blocks, equal vectors, and vectors that are null, empty, without length, too short or hold a null."""
    import random

    monkeypatch.setattr(R, "BROADCAST_NUMBERS", 40)
    rng = random.Random(7)
    vectors = [[rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(4)] for _ in range(12)] + [None, [], [0.0] * 4, [1.0, 2.0], [1.0, None, 0.0, 1.0]]
    items = [(i % 7 if i < 40 else 9, "s" if i % 3 else "t", f"{i * 37 % 101:03}", vectors[i * 5 % len(vectors)]) for i in range(101)]
    items.sort(key=lambda r: r[0])
    asked = [(q, vectors[q]) for q in range(len(vectors))]
    frame = spark.createDataFrame(items, "doc_id long, strategy_id string, chunk_index string, embedding array<float>").coalesce(2)
    found = R.rank_by_embedding(spark.createDataFrame(asked, "query_id long, query_embedding array<float>"), frame, 3)

    def cosine(a, b):
        if not a or not b or len(a) != len(b) or None in a or None in b:
            return 0.0
        size = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / size if size else 0.0

    wanted = []
    for q, v in asked:
        for group in {r[:2] for r in items}:
            best = sorted((-round(cosine(v, r[3]), 9), r[2]) for r in items if r[:2] == group)[:3]
            wanted += [(q, *group, c, round(0.0 - s, 6), k + 1) for k, (s, c) in enumerate(best)]
    assert sorted((r.query_id, r.doc_id, r.strategy_id, r.chunk_index, round(r.score, 6) + 0.0, r["rank"]) for r in found.collect()) == sorted(wanted)
    assert R.rank_by_embedding(spark.createDataFrame(asked[:0], "query_id long, query_embedding array<float>"), frame, 3).count() == 0
    assert "MapInArrow" in (plan := found._jdf.queryExecution().toString()) and "Join" not in plan  # matrix products, no row for each pair


def test_a_report_reads_the_documents_once(spark):
    """The report's three parts share one table of metrics: its plan reads no files."""
    from __spark_entry__ import queries

    report = queries()["export_markdown_lines"](spark, "/root/testdata/sf0.001")
    assert "documents.parquet" not in report._jdf.queryExecution().toString() and report.count() == 35


def test_scores_and_words_are_made_once(spark):
    """Neither does a filter compute all scores of pairs again, nor is a chunk's text split twice to count its words."""
    from __spark_entry__ import queries

    plan = lambda name: queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan("sentence_pairs_similarity").count("array_intersect") == 1
    assert plan("chunk_stats").count("lower(") == 1


def test_html_by_expressions(spark):
    """Headings stand at the first place of their text, and references without a semicolon stay, as in the SQL of the queries."""
    pages = [(1, "<head><title>t</title></head><p>One two</p><h1>One</h1>x<H2> A &amp; B&amp </H2><h3>One</h3>"), (2, "<p>none</p>"), (3, None), (4, "<noscript><h1>gone</h1></noscript>x")]
    frame = spark.createDataFrame(pages, "doc_id long, html string")
    rows = {r.doc_id: r for r in html.with_structure_by_expressions(frame).collect()}
    assert rows[1].text == "One twoOnex A & B&amp One"
    assert [tuple(h) for h in rows[1].structure.headings] == [(1, "One", 0, 3), (2, "A & B&amp", 12, 21), (3, "One", 22, 25)]
    assert (rows[2].text, rows[2].structure.headings, rows[3].text, rows[3].structure.headings) == ("none", [], "", [])
    assert [(h.text, h.start) for h in rows[4].structure.headings] == [("gone", -1)] and rows[4].text == "x"


@pytest.mark.parametrize("name", ["html_headings", "structure_sections", "structure_aware"])
def test_pages_match_their_sql(spark, tmp_path, name):
    """A heading whose text stands in front of it already, and one that ends in a reference without a semicolon."""
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    pages = [(1, "<p>Same words</p><h1>Same words</h1><p>More of it.</p>"), (2, "<h1>Here &amp</h1><p>More &amp; more.</p>")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    with duckdb.connect() as duck:
        duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        wanted = sorted(duck.execute(oracle_sql()[name]).fetchall())
    assert sorted(map(tuple, queries()[name](spark, str(tmp_path)).collect())) == wanted and len(wanted) == 2


def test_pdf(spark):
    items = [(1, 1, 0, "Title", 20.0), (1, 1, 1, "body text", 10.0), (1, 1, 2, "ab", 30.0), (1, 2, 0, " Head ", 14.0), (1, 2, 1, "more", 10.0), (1, 3, 0, "end", 11.5), (2, 1, 0, "zero", 0.0)]
    frame = spark.createDataFrame(items, "doc_id long, page int, seq int, str string, height double")
    rows = {r.doc_id: r for r in pdf.assemble(frame).collect()}
    text = "Title body text ab\n\n Head  more\n\nend"
    assert rows[1].text == text
    assert [(p.number, p.start, p.end) for p in rows[1].structure.pages] == [(1, 0, 20), (2, 20, 33), (3, 33, 36)]
    # the upper median of 10, 10, 11.5, 14, 20, 30 is 14
    assert [(h.level, h.text, h.start) for h in rows[1].structure.headings] == [(2, "Title", 0)]
    assert rows[2].text == "zero" and rows[2].structure.headings == []
    assert {r.doc_id: r.body for r in pdf.body_size(frame).collect()} == {1: 14.0, 2: 12.0}
    page = P.select_page(pdf.assemble(frame), 3).collect()
    assert [r.text for r in page] == ["end"]


def test_pdf_without_a_library_says_so(spark):
    with pytest.raises(Exception, match="pdfminer"):
        pdf.extract_items(spark.createDataFrame([("a", bytearray(b"%PDF"))], "doc_id string, content binary")).collect()


def test_files(spark, tmp_path):
    from passagelab.sources.files import read_documents, read_files

    (tmp_path / "a.html").write_text("<h1>A</h1>b")
    (tmp_path / "b.HTM").write_text("c")
    (tmp_path / "c.txt").write_text("no")
    (tmp_path / "d.PDF").write_bytes(b"%PDF")
    assert {(r.filename, r.format) for r in read_files(spark, str(tmp_path)).collect()} == {("a.html", "html"), ("b.HTM", "html"), ("d.PDF", "pdf")}
    (tmp_path / "d.PDF").unlink()
    assert {(r.filename, r.text) for r in read_documents(spark, str(tmp_path)).collect()} == {("a.html", "Ab"), ("b.HTM", "c")}


def test_exports(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "s", 0, 'a "q"\nb', 2), (1, "s", 1, "c", 1), (2, "t", 0, "", 0)], "doc_id long, strategy_id string, index int, text string, tokens int")
    metrics = spark.createDataFrame([(1, "s", 0.12345, 1.0)], "doc_id long, strategy_id string, avg_self_containedness double, avg_boundary_coherence double")
    rows = exports.csv_rows(chunks, metrics)
    lines = sorted(r.value for r in exports.csv_lines(rows).collect())
    assert lines == ['s,0,2,0.123,1.000,"a \\"q\\" b"', 's,1,1,0.123,1.000,"c"', 't,0,0,,,""']
    exports.write_csv(rows.coalesce(1), str(tmp_path / "csv"))
    assert spark.read.text(str(tmp_path / "csv")).first().value == exports.CSV_HEADER
    import json

    one = json.loads(exports.json_object(chunks.select("index", F.lit(None).cast("string").alias("gone")), metrics, chunks.limit(0)).first().value)
    assert len(one["chunkResults"]) == 3 and one["queryResults"] == [] and "gone" not in one["chunkResults"][0]
    exports.write_json(str(tmp_path / "json"), chunks=chunks, metrics=metrics)
    assert spark.read.json(str(tmp_path / "json/chunks")).count() == 3
    table = spark.createDataFrame([("a_b", 0.5, 0.25, 0.75, 3, 12.5, 0.5), ("c", 0.9, 0.9, 0.9, 1, 4.0, 0.9)], "strategy_id string, avg_self_containedness double, avg_boundary_coherence double, token_efficiency double, chunk_count long, avg_tokens double, composite double")
    runs = spark.createDataFrame([("Label", 3, 20, 0.00015)], "label string, chunk_count long, duration_ms long, estimated_cost double")
    text = [r.value for r in exports.markdown_lines(table, runs).orderBy("line").collect()]
    assert text[6:8] == ["| c | 0.90 | 0.90 | 0.90 | 1 | 0.90 |", "| a_b | 0.50 | 0.25 | 0.75 | 3 | 0.50 |"]
    assert "### 2. a b" in text and "- Chunk count: 3 · Avg tokens: 13" in text and text[-1] == "- **Label**: 3 chunks, 20ms, ~$0.0001"


def test_cache(spark, tmp_path):
    path, frame = str(tmp_path / "runs"), docs(spark)
    first = run_cached(frame, S.SlidingSummary(), path).collect()
    files = len(list((tmp_path / "runs").glob("*.parquet")))
    again = run_cached(frame, S.SlidingSummary(), path).collect()
    assert sorted(r.doc_id for r in first) == sorted(r.doc_id for r in again) == [1, 2, 3, 4]
    assert spark.read.parquet(path).count() == 4 and files >= 1
    run_cached(frame, S.SlidingSummary(size=200), path).collect()
    assert spark.read.parquet(path).count() == 8
    failed = run_cached(docs(spark, [(9, "Aa bb. Cc dd. Ee ff.")]), S.KamradtSemantic(), path, answers(lambda p: "[1.2.3]")).collect()
    assert [(r.doc_id, r.chunks) for r in failed] == [(9, [])] and "cannot be read" in failed[0].error
    assert run_profile(spark.createDataFrame(first, run_cached(frame, S.SlidingSummary(), path).schema)).count() == 4
    assert unused(spark, spark.createDataFrame([("late",)], "strategy_id string")).count() == 6


def test_stream_equals_batch(spark, tmp_path):
    for k, row in enumerate(DOCS):
        spark.createDataFrame([row], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    (tmp_path / "flat").mkdir()
    for k, f in enumerate((tmp_path / "in").rglob("part-*.parquet")):
        f.rename(tmp_path / "flat" / f"{k}.parquet")
    chunks = stream.chunk_stream(stream.read_documents(spark, str(tmp_path / "flat"), files_per_trigger=1), S.SlidingSummary())
    running = stream.write_chunks(chunks, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    running.awaitTermination(120)
    got = sorted((r.doc_id, r["index"], r.text) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted((r.doc_id, r["index"], r.text) for r in S.chunk_documents(docs(spark), S.SlidingSummary()).collect())
    assert got == want
    assert stream.chunk_counts(chunks).isStreaming


def test_settings_of_a_file_and_the_environment(spark, tmp_path):
    from passagelab.sources.settings import Settings, load_settings

    (tmp_path / "s.json").write_text('{"provider": "ollama", "top_k": 3, "pause": 0}')
    found = load_settings(spark, str(tmp_path / "s.json"), {"PASSAGELAB_TOP_K": "7", "PASSAGELAB_MODEL": "m"})
    assert found == Settings(provider="ollama", top_k=7, pause=0.0, model="m") and load_settings(environment={}) == Settings()
    for bad in ({"PASSAGELAB_PROVIDER": "x"}, {"PASSAGELAB_SELF_SAMPLE": "2"}, {"PASSAGELAB_EMBEDDING_MODE": "x"}):
        with pytest.raises(ValueError):
            load_settings(environment=bad)
    (tmp_path / "t.json").write_text('{"colour": 1}')
    with pytest.raises(ValueError):
        load_settings(spark, str(tmp_path / "t.json"), {})


def test_streamed_answers_are_put_together(monkeypatch):
    from passagelab.functions.judges import Provider

    anthropic = [b"event: message_start\n", b'data: {"type":"message_start","message":{"usage":{"input_tokens":12,"output_tokens":1}}}\n', b"\n", b'data: {"type":"content_block_delta","delta":{"type":"text_delta","text":"Hel"}}\n', b'data: {"type":"content_block_delta","delta":{"text":"lo"}}\n', b'data: {"type":"message_delta","delta":{},"usage":{"output_tokens":5}}\n']
    assert Provider("anthropic", "m", streamed=True).gathered(anthropic) == {"text": "Hello", "input_tokens": 12, "output_tokens": 5}
    gemini = [b'data: {"candidates":[{"content":{"parts":[{"text":"a"}]}}]}\n', b'data: {"candidates":[{"content":{"parts":[{"text":"b"}]}}],"usageMetadata":{"promptTokenCount":3,"candidatesTokenCount":2}}\n']
    assert Provider("gemini", "m").gathered(gemini) == {"text": "ab", "input_tokens": 3, "output_tokens": 2}
    ollama = [b'{"message":{"content":"x"}}\n', b'{"message":{"content":"y"},"done":true,"prompt_eval_count":4,"eval_count":2}\n']
    assert Provider("ollama", "m").gathered(ollama) == {"text": "xy", "input_tokens": 4, "output_tokens": 2}
    with pytest.raises(ValueError):
        Provider("ollama", "m").gathered([b'{"error":"overloaded"}'])
    assert Provider("gemini", "m", streamed=True).request("p", 5)[0].endswith(":streamGenerateContent?alt=sse")
    monkeypatch.delenv("NO_SUCH_KEY", raising=False)
    with pytest.raises(ValueError, match="NO_SUCH_KEY"):
        Provider("anthropic", "m", key_variable="NO_SUCH_KEY").request("p", 5)


def test_answers_are_kept(spark, tmp_path):
    from passagelab.functions.judges import FunctionJudge

    log = tmp_path / "asked"

    def answer(prompt, most):
        with log.open("a") as f:
            f.write(f"{prompt}\n")
        if prompt == "bad":
            raise OSError("no")
        return {"text": prompt.upper(), "input_tokens": 1, "output_tokens": 2}

    judge = FunctionJudge(function=answer, answers=str(tmp_path / "answers"))
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,), ("bad",)], "p string")
    for _ in range(2):
        rows = [(r.p, r.said and (r.said.text, r.said.error)) for r in judge.complete(df, "p", "said", 9).collect()]
        assert sorted(rows, key=repr) == sorted([("a", ("A", None)), ("b", ("B", None)), ("a", ("A", None)), (None, None), ("bad", (None, "no"))], key=repr)
    assert sorted(log.read_text().split()) == ["a", "b", "bad", "bad"]


PDFMINER = {
    "pdfminer/__init__.py": "",
    "pdfminer/layout.py": """
class LTTextLine:
    def __init__(self, text, height):
        self.text, self.height = text, height

    def get_text(self):
        return self.text + chr(10)


class LTTextContainer(list):
    pass
""",
    "pdfminer/high_level.py": """
from pdfminer.layout import LTTextContainer, LTTextLine


def extract_pages(stream):
    for page in stream.read().decode().split("|"):
        yield [LTTextContainer(LTTextLine(t, 10.0 + len(t)) for t in page.split(";")), "a figure"]
""",
}


def test_pdf_files_with_a_stand_in_for_the_library(spark, tmp_path, monkeypatch):
    import zipfile

    with zipfile.ZipFile(tmp_path / "stand_in.zip", "w") as bundle:
        for name, code in PDFMINER.items():
            bundle.writestr(name, code)
    spark.sparkContext.addPyFile(str(tmp_path / "stand_in.zip"))
    files = spark.createDataFrame([("d1", bytearray(b"Title;some text|more")), ("d2", bytearray(b"one"))], "doc_id string, content binary")
    found = sorted((r.doc_id, r.page, r.seq, r.str, r.height) for r in pdf.extract_items(files).collect())
    assert found == [("d1", 1, 0, "Title", 15.0), ("d1", 1, 1, "some text", 19.0), ("d1", 2, 0, "more", 14.0), ("d2", 1, 0, "one", 13.0)]


def test_chunking_computes_its_parts_once(spark):
    from passagelab.functions.judges import HeuristicJudge
    from passagelab.operators.passages import as_documents
    from passagelab.operators.strategies import KamradtSemantic

    docs = as_documents(spark.createDataFrame([(1, "One two. Three four.")], "doc_id long, text string"))
    plan = S.chunk_rows(KamradtSemantic().apply(docs, HeuristicJudge()), "doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 4 and plan.count("array_intersect") == 1
