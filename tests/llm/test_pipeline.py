"""The pipeline: stages in order, decisions that take effect, and the same rows as the operators' own reports."""

import zlib

import corpus_pipeline
from fluxgauge.llm import decontaminate, quality, simhash


def test_pipeline(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    docs = d
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == d.columns, name
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert kept[0] >= kept[1] >= kept[2] and len(kept[2]) > 0
    # Each stage against its operator's report on its own input.
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = quality.score(d, quality.train(d, labels)).where("predicted = 1")
    assert kept[0] == {r.doc_id for r in good.collect()}
    first = d.join(good.select("doc_id"), "doc_id")
    assert kept[1] == {r.component_id for r in simhash.components(first).collect()}
    second = first.where(first.doc_id.isin(sorted(kept[1])))
    clean = decontaminate.report(second, spark.read.parquet(f"{sf}/benchmark.parquet")).where("NOT contaminated")
    assert kept[2] == {r.doc_id for r in clean.collect()}
    out = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in out.collect()} == kept[2]


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, fingerprint string"


def tables(spark, folder, rows, labelled=(), items=()):
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 0.5, "f") for i, t in rows], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labelled), "doc_id bigint, quality bigint, toxic bigint").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path / "a", [])).count() == 0


def test_nulls_repeats_ties_and_very_long_texts(spark, tmp_path):
    """Without labels nothing is rejected for quality; equal texts are one; a text that is half benchmark goes."""
    item = " ".join(f"word{i}" for i in range(40))
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(120_000))
    rows = [(1, None), (2, ""), (3, "same text of some words"), (4, "same text of some words"), (4, "same text of some words"), (5, long), (6, f"{item} and more"), (7, "another text, quite different"), (None, "a text without an id")]
    sf = tables(spark, tmp_path / "b", rows, [], [(0, item)])
    out = corpus_pipeline.run(spark, sf)
    kept = sorted((r.doc_id for r in out.collect()), key=lambda x: (x is None, x))
    assert kept == [1, 3, 5, 7, None]
    counts = {r.doc_id: r.n_tokens for r in out.collect()}
    assert counts[1] == 0 and counts[5] > 120_000


def test_stages_keep_columns_and_folders_go(spark, tmp_path):
    import os

    sf = tables(spark, tmp_path / "c", [(i, f"text number {i} of words {i * 7} and {i * 13}") for i in range(30)], [(i, i % 2, 0) for i in range(30)])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns, name
    corpus_pipeline.run(spark, sf).count()
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    newest = max((d for d in os.listdir(root) if d.startswith("pipeline-")), key=lambda d: os.stat(f"{root}/{d}").st_mtime)
    assert [d for d in os.listdir(f"{root}/{newest}") if not d.startswith(".")] == ["3_bpe"]


def test_quality_on_held_out_labels(spark, sf):
    import os

    big = sf.replace("0.001", "0.1")
    if not os.path.isdir(big):
        big = sf
    d, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.score(d, quality.train(d, labels)).join(labels, "doc_id").where("held_out").toPandas()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in scored.doc_id)
    assert (scored.predicted == scored.quality).mean() > 0.95
