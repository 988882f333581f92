import corpus_pipeline
from pyspark.sql import functions as F

import __spark_entry__
from millrace.llm import line_crf, order_minhash, registry


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert set(registry.QUERIES) <= names and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= names


def test_pipeline_stages(spark, sf_dir):
    """Each stage on its own input: what goes, what stays, and the columns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        path = f"{spark.sparkContext.getCheckpointDir() or '/tmp'}/test-{name}-{id(docs)}"
        stage(spark, before, sf_dir).write.parquet(path)
        after = spark.read.parquet(path)
        if name != "token_ids":
            assert after.columns == docs.columns
        if name == "quality":
            scores = {r["doc_id"]: r["quality_found"]["score"] for r in line_crf.score(docs, line_crf.trained(spark, sf_dir)).collect()}
            assert {r["doc_id"] for r in after.collect()} == {k for k, s in scores.items() if s >= line_crf.THRESHOLD}
        if name == "near_duplicates":
            classes = {r["class_id"] for r in order_minhash.with_class(before).collect()}
            assert sorted(r["doc_id"] for r in after.collect()) == sorted(classes)
        if name == "personal_data":
            assert after.count() == before.count()
            assert after.where(F.col("text").rlike(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[A-Za-z]")).isEmpty()
            assert after.where(F.char_length("text") != F.col("n_chars")).isEmpty()
        if name == "source_weights":
            assert {r["doc_id"] for r in after.collect()} <= {r["doc_id"] for r in before.collect()}
            assert after.groupBy("doc_id").count().where("count > 2").isEmpty()
        if name == "token_ids":
            assert after.count() == before.count()
            assert after.join(before.select("doc_id", F.sha2("text", 256).alias("decoded_sha256")).distinct(), ["doc_id", "decoded_sha256"], "left_anti").isEmpty()
        before = after


CLASHING = ["size", "source_size", "target", "copies", "taken", "a.b", "text_digest", "quality_found", "lost_id", "lost_digest", "row_rank", "class_found", "spans", "added", "digest", "label", "key", "salt", "hash", "tie", "copy", "bucket", "own_size"]


def test_stages_on_odd_rows_and_clashing_columns(spark):
    """Null, empty, very long, tied and repeated rows, null ids, and columns with names that the stages use."""
    sf_dir = "/root/testdata/sf0.001"
    good = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1"), "doc_id").orderBy("doc_id").limit(4).collect()]
    long = " ".join(good * 60)
    texts = [(1, None), (2, ""), (3, long), (4, good[0]), (4, good[0]), (5, good[0]), (None, good[1]), (None, good[1]), (6, good[1]), (7, good[2] + " write to jane@corp.example"), (8, good[3])]
    rows = [(k, t, "en", None if k == 8 else "s", None if t is None else len(t), *(f"{c}-{n}" for c in CLASHING)) for n, (k, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in CLASHING))
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf_dir)
        assert name == "token_ids" or made.columns == docs.columns
        out[name] = made.collect()
        assert stage(spark, docs.limit(0), sf_dir).collect() == []
    assert {tuple(r) for r in out["quality"]} <= set(rows) and {r["doc_id"] for r in out["quality"]} >= {3, 4, 5, 6, 7, 8}
    assert sorted(((str(r["doc_id"]), r["text"]) for r in out["near_duplicates"]), key=lambda x: x[0]) == [("1", None), ("3", long), ("4", good[0]), ("6", good[1]), ("7", texts[9][1]), ("8", good[3])]
    assert {tuple(r) for r in out["near_duplicates"]} <= set(rows)
    clean = {r["size"]: r for r in out["personal_data"]}
    assert len(clean) == len(rows) and clean["size-0"]["text"] is None and clean["size-1"]["text"] == "" and clean["size-9"]["text"].endswith("write to [EMAIL]") and clean["size-9"]["n_chars"] == len(clean["size-9"]["text"])
    assert all(clean[f"size-{n}"][c] == f"{c}-{n}" for n in range(len(rows)) for c in CLASHING)
    assert {tuple(r) for r in out["source_weights"]} <= set(rows)
    tokens = [(str(r["doc_id"]), r["n_tokens"], r["decoded_sha256"]) for r in out["token_ids"]]
    assert len(tokens) == len(rows) and sum(n == 1 for _, n, _ in tokens) == 2


def test_pipeline_on_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
