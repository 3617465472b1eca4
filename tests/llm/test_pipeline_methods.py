import corpus_pipeline
from tallyspark.llm import minhash, simhash


def test_near_duplicates_by_fingerprints_and_by_shingles(spark, monkeypatch):
    words = [f"word{i}" for i in range(300)]
    texts = [" ".join(words), " ".join(words[:299] + ["other"]), " ".join(f"x{i}" for i in range(200)), " ".join(f"y{i}" for i in range(200))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(9, texts[2], "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars int")
    asked = []
    plain = simhash.near_duplicates
    monkeypatch.setattr(simhash, "near_duplicates", lambda d: asked.append(1) or plain(d))
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()}
    assert asked and kept == {0, 2, 3}
    linked = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, 2), (9, 9)], "doc_id long, component_id long")  # another method's links count as well
    assert {(r[0], r[1]) for r in minhash.widened(docs, linked).collect()} == {(0, 0), (1, 0), (2, 2), (3, 2), (9, 2)}
