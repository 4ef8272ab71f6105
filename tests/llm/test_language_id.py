import numpy as np

from passagelab.llm.language_id import Space, held_out, identify, keep_identified, predict, predict_text, train, trigrams
from tests.llm.odd import documents, empty, odd


def vector_by_hand(text, space):
    """The bundle of a text's trigrams, one letter after another."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    letters = " " + " ".join(letters.split()) + " "
    total = np.zeros(space.dimensions)
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        total += np.roll(space.letter(ord(a)), 2) * np.roll(space.letter(ord(b)), 1) * space.letter(ord(c))
    return total


def test_bundles_match_the_definition():
    space = Space(256, 5)
    for text in ("Hello,  World!", "à bientôt", "x", "漢字 かな", "a1b2"):
        assert np.array_equal(space.bundle(*trigrams(text)), vector_by_hand(text, space))
    assert len(trigrams(None)[0]) == len(trigrams("123 !?")[0]) == len(trigrams("")[0]) == 0


def test_training_and_prediction_match_the_definition(spark):
    docs = documents(spark)
    model = train(docs.where("doc_id < 60"), dimensions=128, seed=3)
    space = Space(128, 3)
    rows = docs.collect()
    assert list(model.languages) == sorted({r.lang for r in rows if r.doc_id < 60})
    for lang, prototype in zip(model.languages, model.prototypes):
        total = sum(vector_by_hand(r.text, space) for r in rows if r.doc_id < 60 and r.lang == lang)
        assert np.allclose(prototype, total / np.linalg.norm(total))
    for r in predict(docs.where("doc_id < 80"), model).collect():
        vector = vector_by_hand(r.text, space)
        cosines = model.prototypes @ vector / np.linalg.norm(vector)
        assert r.lang_pred == model.languages[int(np.argmax(cosines))] and abs(r.score - max(0, cosines.max())) < 1e-5


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = identify(docs).where("held_out").collect()
    right = sum(r.lang == r.lang_pred for r in found)
    assert len(found) > 200 and right / len(found) >= 0.98
    assert all(0 <= r.score <= 1 for r in found)


def test_label_source_and_id_do_not_decide(spark):
    docs = documents(spark).where("doc_id < 100")
    model = train(documents(spark))
    a = {r.doc_id: (r.lang_pred, r.score) for r in predict(docs, model).collect()}
    b = {r.doc_id - 1000: (r.lang_pred, r.score) for r in predict(docs.selectExpr("doc_id + 1000 as doc_id", "text", "'zz' as lang", "'q' as source"), model).collect()}
    assert a == b


def test_odd_rows(spark):
    found = identify(odd(spark)).collect()
    assert len(found) == 12
    unknown = [r for r in found if r.lang_pred == "und"]
    assert len(unknown) == 5 and all(r.score == 0 for r in unknown)  # two nulls, empty, blank, digits
    assert {r.lang_pred for r in found} == {"und", "en"}
    assert all(not r.held_out for r in found if r.doc_id is None)
    assert identify(empty(spark)).count() == 0
    kept = keep_identified(odd(spark))
    assert kept.columns == odd(spark).columns and kept.count() == 7


def test_other_columns_of_any_name(spark):
    docs = spark.createDataFrame([(k, t, "en", k + 0.5, "kept", "x") for k, t in enumerate(["one two three words", "12 !", "more words here"])], "doc_id long, text string, lang string, score double, lang_pred string, _score string")
    assert sorted(tuple(r) for r in keep_identified(docs).collect()) == [(0, "one two three words", "en", 0.5, "kept", "x"), (2, "more words here", "en", 2.5, "kept", "x")]


def test_nothing_learned(spark):
    model = train(empty(spark))
    assert predict_text("some text", model, Space(1024, 1)) == ("und", 0.0)


def test_fold_is_crc32(spark):
    import zlib

    frame = spark.range(50).selectExpr("id as doc_id").withColumn("h", held_out())
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in frame.collect())
