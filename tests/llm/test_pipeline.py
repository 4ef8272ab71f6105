import corpus_pipeline
from passagelab.llm.common import table
from tests.llm.odd import empty, odd
from tests.llm.test_decontamination import by_hand as contaminated
from tests.llm.test_shingle_dedup import by_hand as kept_of

SF = "/root/testdata/sf0.001"


def test_stages_on_the_table(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, frames = docs.columns, [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], SF).write.parquet(str(tmp_path / f"{k}-{name}"))
        frames.append(spark.read.parquet(str(tmp_path / f"{k}-{name}")))
        if k < 4:
            assert frames[-1].columns == columns, name
    rows = [f.collect() for f in frames]
    texts = [{r.doc_id: r.text for r in own} for own in rows[:5]]

    assert texts[1] == {i: t for i, t in texts[0].items() if t and any(c.isalpha() for c in t)}
    assert texts[2].keys() <= texts[1].keys() and all(r.n_chars == len(r.text) for r in rows[2])
    assert texts[3] == {i: texts[2][i] for i in kept_of(sorted(texts[2].items()))}
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    wanted = contaminated(list(texts[3].items()), items)
    assert texts[4].keys() == {w[1] for w in wanted if w[3] == 0} and any(w[3] for w in wanted)
    assert {r.doc_id for r in rows[5]} == texts[4].keys()
    assert sorted(corpus_pipeline.run(spark, SF).select("doc_id", "start", "length", "ids_crc32").collect()) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rows[5])


def test_odd_and_empty_inputs(spark, tmp_path):
    for make in (odd, empty):
        docs = make(spark)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, SF).write.parquet(str(tmp_path / f"{make.__name__}{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{make.__name__}{k}"))
        assert (docs.count() > 0) == (make is odd)


def test_no_benchmark_window_comes_through(spark):
    item = " ".join(f"item{k}" for k in range(30))
    filler = " ".join(f"filler{k % 997}" for k in range(20_000))
    docs = [(1, f"{filler} {' '.join(f'item{k}' for k in range(5, 18))} {filler}"), (2, f"{filler} {' '.join(f'item{k}' for k in range(5, 17))} {filler}"), (3, "Item5, " + " ".join(f"item{k}." for k in range(6, 18)))]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t), "x", 1) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long, _id string, n_hit int")
    from passagelab.llm.decontamination import keep_clean, report

    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    kept = keep_clean(frame, items)
    assert kept.columns == frame.columns and [tuple(r) for r in kept.collect()] == [(2, docs[1][1], "en", "s", len(docs[1][1]), "x", 1)]
    assert {r.doc_id: r.contaminated for r in report(frame, items).collect()} == {1: False, 2: False, 3: True}
