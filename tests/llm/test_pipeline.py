"""The pipeline's decisions on a small corpus with known cases."""

import random

import corpus_pipeline
from pyspark.sql import functions as F


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(11)
    prose = lambda n: " ".join("".join(rng.choices(["the", "of", "ing", "tion", "er"], k=3)) for _ in range(n))
    item = prose(30)
    rows = [(i, prose(80), "en", f"s{i % 3}", 1) for i in range(30)]
    rows += [(100, rows[2][1], "en", "s0", 1), (101, rows[3][1] + " more", "en", "s1", 1), (102, prose(20) + " " + item, "en", "s2", 1), (103, "12 34", "en", "s0", 1), (104, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.keep(stage(spark, docs, str(tmp_path)), name)
        left[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert left["language_id"] == {r[0] for r in rows} - {103, 104}
    assert left["ngram_jaccard"] == {*range(30), 102}
    assert left["decontamination"] == {*range(30)}
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert final.count() == docs.count() and final.agg(F.max("shard_bytes")).first()[0] <= corpus_pipeline.SHARD_BYTES


def test_stages_keep_rows_apart_and_columns_whole(spark, tmp_path):
    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choices(["the", "of", "ing", "tion", "er"], k=3)) for _ in range(n))
    names = "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred string, held_out int, size string, b long, row_key string, jaccard_key int"
    extra = ("s", "p", 1, "z", 2, "r", 3)
    a, b, c, d = (prose(60) for _ in range(4))
    rows = [(1, a), (2, a), (2, b), (3, b), (5, c), (5, c), (None, d), (None, d), (None, d + " more"), (6, ""), (7, None)]
    rows = [(i, t, "en", None if i == 5 else "s0", 1, *extra) for i, t in rows]
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (rows, []):
        docs = spark.createDataFrame(table, names)
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.keep(stage(spark, docs, str(tmp_path)), name)
            if name != "sharding":
                assert docs.columns == columns and {tuple(r)[5:] for r in docs.collect()} <= {extra}
            if name == "language_id" and table:
                assert docs.count() == 9
            if name == "ngram_jaccard" and table:
                left = sorted(((r["doc_id"] or 0, r["text"]) for r in docs.collect()), key=str)
                assert [i for i, _ in left] == [0, 1, 2, 5] and {t for _, t in left if _} == {a, b, c} and left[0][1] in (d, d + " more")
        assert docs.count() == 0 or table
