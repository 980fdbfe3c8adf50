import hashlib
import re

import public_tokenizers
import sentencepiece

import __spark_entry__
import corpus_pipeline
from agentmetrics.session import durable
from tests.llm.test_similar import kept_by_brute_force


def test_stages_follow_each_other(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, before = docs.columns, docs.count()
    outputs = []
    for _, stage in corpus_pipeline.STAGES:
        docs = durable(stage(spark, docs, folder))
        outputs.append(docs)
    good, exact, near, mixed, encoded = outputs
    assert all(o.columns == columns for o in outputs[:-1])
    assert 0.6 * before < good.count() < before
    plain = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in exact.collect()]
    assert len(set(plain)) == len(plain)
    assert sorted(r.doc_id for r in near.collect()) == kept_by_brute_force([(r.doc_id, r.text) for r in exact.collect()])
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in near.collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((r.doc_id, hashlib.sha256(",".join(map(str, library.encode(r.text or ""))).encode()).hexdigest())
                  for r in mixed.collect())
    assert sorted((r.doc_id, r.ids_sha256) for r in encoded.collect()) == want
    again = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id, r.ids_sha256) for r in again.collect()) == want


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 14)} <= {n.split("_")[0] for n in names}


def test_stages_on_odd_rows_and_empty_tables(spark, odd, tmp_path, labels):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, odd.limit(0)):
        columns, rows = docs.columns, docs.count()
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = durable(stage(spark, docs, str(tmp_path)))
            assert docs.columns == columns
        encoded = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        assert encoded.count() == docs.count() and (docs.count() > 0) == (rows > 0)


def test_stages_bound_their_batches_and_leave_no_cuts_behind(spark):
    name, before = "spark.sql.execution.arrow.maxBytesPerBatch", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    try:
        good = corpus_pipeline.keep_good_texts(spark, docs, folder)
        assert int(spark.conf.get(name).removesuffix("b")) == 4 << 20
        sent = good._jdf.queryExecution().optimizedPlan().toString()
        assert "_text" not in sent  # the document holds its text already
        corpus_pipeline.encode(spark, docs.repartition(8), folder).count()

        def held(batches):
            import pyarrow as pa

            from agentmetrics.llm import piece_encoding
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([len(piece_encoding._ENCODERS)] * batch.num_rows, pa.int64())], ["id"])
        assert {r.id for r in spark.range(64).repartition(8).mapInArrow(held, "id long").collect()} == {0}
        spark.conf.set(name, "1000")
        corpus_pipeline.keep_good_texts(spark, docs, folder)
        assert spark.conf.get(name) in ("1000", "1000b")
    finally:
        spark.conf.set(name, before)
