"""The pipeline's stages in order, each on what the one before has kept."""

import numpy as np

import corpus_pipeline
import __spark_entry__
from tallyspark.llm import minhash, simhash
from tallyspark.session import stage

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_do_their_work(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, step in corpus_pipeline.STAGES:
        docs = stage(spark, step(spark, docs, SF), name)
        seen[name] = docs
        if name != "tokens":
            assert docs.columns == columns
    n = {k: v.count() for k, v in seen.items()}
    assert n["language_id"] >= n["near_duplicates"] >= n["decontamination"] > 0
    assert n["tokens"] == n["mixing"]
    bench = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(b in r["text"] for r in seen["decontamination"].collect() for b in bench)
    assert sorted(r["start"] for r in seen["tokens"].collect())[0] == 0


def test_near_duplicates_are_those_of_brute_force(spark):
    rng = np.random.default_rng(9)
    word = lambda: f"w{rng.integers(0, 4000)}"
    texts = [None, "", " ", "one two", "One  TWO", "one two three"]
    for group in range(12):
        base = [word() for _ in range(150)]
        texts += [" ".join(base)] * 2
        for changes in (1, 2, 3, 4, 6, 12):  # similarities from about 0.94 down to 0.4
            other = list(base)
            for at in rng.choice(150, changes, replace=False):
                other[at] = word()
            texts.append(" ".join(other))
    sets = [set(minhash.shingles(t).tolist()) for t in texts]
    component = list(range(len(texts)))
    wide = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                lo, hi = sorted((component[i], component[j]))
                component = [lo if c == hi else c for c in component]
                x, y = simhash.fingerprints([texts[i], texts[j]])
                wide += int(x ^ y).bit_count() > 3
    assert wide > 10  # pairs that the fingerprints of op10 don't link
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()} == dict(enumerate(component))
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()} == set(component)
    assert corpus_pipeline.drop_near_duplicates(spark, docs.where("false"), SF).collect() == []


def test_run_is_registered(spark):
    queries = __spark_entry__.queries()
    assert {f"op{i}" for i in range(1, 11)} == {k.split("_")[0] for k in queries if k.startswith("op")}
    got = queries["pipeline"](spark, SF)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 0
