"""The stages of the pipeline on a small corpus with planted cases."""

import random

import corpus_pipeline
from tests.llm.test_minhash import brute


def corpus():
    rnd = random.Random(9)
    vocabulary = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        w = rnd.choices(vocabulary, k=60)
        toxic = i % 10 == 0
        for _ in range(8 if toxic else 0):
            w[rnd.randrange(60)] = rnd.choice(["vileones", "vileling", "vilest"])
        rows.append([i, "site menu\n" + " ".join(w), "en", f"s{i % 3}", 0])
        labels.append((i, 1, int(toxic)))
    item = " ".join(rnd.choices(vocabulary, k=30))
    for k in range(700, 710):
        text = rows[k - 699][1].split(" ")
        text[10] = "changed"
        rows.append([k, " ".join(text), "en", "s1", 0])
    rows.append([800, "site menu\n" + item, "en", "s2", 0])
    rows += [[801, None, None, None, None], [802, "", "en", "s0", 0], [None, "no id here", "en", "s0", 1]]
    return rows, labels, [(1, item), (2, None)]


def test_each_stage_takes_effect(spark, tmp_path):
    rows, labels, items = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        seen[name] = docs.collect()
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {name: {r.doc_id for r in found} for name, found in seen.items()}
    everyone = {r[0] for r in rows}
    toxic = set(range(0, 600, 10))
    assert len(toxic - ids["toxicity"]) >= 58 and len(everyone - ids["toxicity"] - toxic) <= 6
    assert ids["line_dedup"] == ids["toxicity"]
    texts = {r.doc_id: r.text for r in seen["line_dedup"]}
    assert all("site menu" not in (t or "") for t in texts.values()) and all(r.n_chars == (len(r.text) if r.text is not None else None) for r in seen["line_dedup"])
    group = brute([(d, t) for d, t in texts.items() if d is not None])
    assert ids["near_dedup"] == {d for d in group if group[d] == d} | ids["line_dedup"] & {None}
    assert ids["near_dedup"] - ids["decontamination"] == {800}
    assert ids["mixing"] == ids["decontamination"]
    assert all(0 <= r.taken <= 3 * r.size for r in seen["mixing"])


def test_run(spark, tmp_path):
    spark.createDataFrame([(1, "a b c", "en", "x", 5)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [(r.doc_id, r.size, r.taken) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()] == [(1, 3, 3)]


def test_repeated_rows_and_no_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "q " * 12)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    twice = [(1, "a b c d e f", "en", "x", 5)] * 2 + [(2, "a b c d e f", "en", "y", 5), (3, "b", None, None, None), (3, "a", None, None, None)]
    spark.createDataFrame(twice, schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, "a b c d e f"), (3, "a")]
