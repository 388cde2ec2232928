"""The pipeline's stages against plain loops over a small corpus."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    syllables = "th an re in er on at en ti es".split()
    prose = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(n))
    clean = [prose(rng.randint(60, 120)) for _ in range(60)]
    junk = [" ".join(w + "$$$" for w in prose(80).split()) for _ in range(40)]
    item = prose(30)
    copies = [clean[0], clean[0] + " end", clean[1]]
    leaked = [prose(40) + " " + item + " " + prose(40)]
    personal = [prose(60) + " mail me at someone.77@mail1.example.com now"]
    texts = [*clean, *junk, *copies, *leaked, *personal]
    docs = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(k, int(k < 60), 0) for k in range(100)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = now.columns
    want = [set(range(60)) | set(range(100, 105)), set(range(60)) | {103, 104}, set(range(60)) | {104}, set(range(60)) | {104}]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        now = spark.read.parquet(str(tmp_path / f"stage{k}"))
        assert now.columns == columns and {r.doc_id for r in now.collect()} == want[k]
    last = {r.doc_id: r for r in now.collect()}
    assert "someone.77" not in last[104].text and last[104].n_chars == len(last[104].text) and last[5].text == clean[5]
    whole = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(whole.doc_id) == want[-1] and whole.groupby("sequence_id").length.sum().max() <= 4096


def test_stages_of_awkward_rows(spark, tmp_path):
    """Null and repeated ids, null and empty texts, further columns with names that operators use, and empty tables."""
    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choice("th an re in er on".split()) for _ in range(rng.randint(1, 4))) for _ in range(n))
    texts = [prose(70) for _ in range(12)]
    rows = [(k, t, None, None, None, 7, "x") for k, t in enumerate(texts)] + [(3, texts[3], "en", "s", 1, 7, "x"), (None, texts[0], "en", "s", 1, 7, "x"), (20, None, "en", "s", 1, 7, "x"), (21, "", "en", "s", 1, 7, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id long, cluster string"
    spark.createDataFrame([(k, 1, 0) for k in range(12)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, None), (None, "some text")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, some in (("full", rows), ("none", [])):
        now = spark.createDataFrame(some, schema)
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"{name}{k}"))
            now = spark.read.parquet(str(tmp_path / f"{name}{k}"))
            assert set(now.columns) == {c.split()[0] for c in schema.split(", ")}
        kept = now.collect()
        ids = sorted((r.doc_id for r in kept if r.doc_id is not None and r.doc_id < 20))
        assert ids == (sorted([*range(12), 3]) if some else []) and sum(r.doc_id is None for r in kept) == (1 if some else 0)
        packed = corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).collect()
        assert sorted(r.doc_id for r in packed if r.doc_id is not None and r.doc_id < 20) == ids and sum(r.doc_id is None for r in packed) == (1 if some else 0)
