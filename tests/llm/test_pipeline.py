import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    good = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(60)]
    junk = [" ".join(rng.choice(words).upper() + "!!" for _ in range(40)) for _ in range(60)]
    texts = [*good, *junk, good[0], good[1] + " mail a@b.example.com"]
    rows = [(i, t, "en", "s", len(t), "extra") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, more string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60)) for i in range(120)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        kept.append({r["doc_id"] for r in docs.collect()})
    assert kept[0] >= set(range(60)) | {120, 121} and not kept[0] & set(range(60, 120))
    assert kept[1] == set(range(60)) and kept[3] == kept[2] == kept[1]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == kept[1]
    assert all("@" not in (r["text"] or "") for r in docs.collect())
