import json

from pyspark.sql import functions as F

from tessera.operators import chunking, retrieval as rv
from tessera.sources import files


def test_custom_extractor_failure_is_quarantined(spark):
    def extractor(blob: bytes):
        if blob.startswith(b"BAD"):
            raise ValueError("broken")
        return [blob.decode(), None, "tail"]

    df = spark.createDataFrame([("/ok", b"head"), ("/bad", b"BAD!")], "path string, content binary")
    good, bad = chunking.split_quarantine(chunking.extract_text(df, extractor))
    assert [r.text for r in good.collect()] == ["head\n\ntail"]
    assert bad.first().error == "Error parsing document: broken"


def test_pages_text(spark):
    df = spark.createDataFrame([(1, ["p1", None, "p3"])], "id long, pages array<string>")
    assert chunking.pages_text(df).first().text == "p1\n\np3"


def test_image_messages_without_system(spark):
    df = spark.createDataFrame([(b"\x00\x01",)], "content binary")
    msgs = json.loads(files.image_messages(df, "Describe", system_prompt=None).first().messages)
    assert len(msgs) == 1 and msgs[0]["role"] == "user"
    assert msgs[0]["content"][1]["image_url"]["url"] == "data:image/png;base64,AAE="


def test_sync_index_first_run_embeds_everything(spark):
    src = spark.createDataFrame([(1, "alpha beta"), (2, "gamma")], "id long, content string")
    idx = rv.sync_index(None, src, embed_with=lambda d: d.withColumn("embedding", F.array(F.lit(1.0))))
    assert sorted((r.id, r.synced) for r in idx.collect()) == [(1, True), (2, True)]


def test_vector_topk_empty_query_set(spark):
    q = spark.createDataFrame([], "qid long, qvec array<double>")
    v = spark.createDataFrame([(1, [1.0, 0.0])], "id long, embedding array<double>")
    assert rv.vector_topk(q, v).count() == 0


def test_moderate_stream_over_several_batches(spark):
    from tessera.operators import moderation as mod
    from tessera.session import shared_dir
    from tessera.streaming import jobs
    reqs = spark.createDataFrame(
        [(i, json.dumps({"messages": [{"role": "user", "content": "bomb" if i % 4 == 0 else f"hi {i}"},
                                      {"role": "assistant", "content": "ok"}]})) for i in range(12)],
        "conv_id long, request string")
    path, _ = jobs.stream_from_table(spark, reqs, "reqs_multi", 6)
    stream = spark.readStream.schema(reqs.schema).option("maxFilesPerTrigger", 4).parquet(path)   # two batches
    model = mod.keyword_guard({"bomb": "S9"})
    out, ckpt = shared_dir(spark, "modm", "out"), shared_dir(spark, "modm", "ckpt")
    jobs.run_to_completion(jobs.moderate_stream(stream, model, out, ckpt))
    got = sorted(tuple(r) for r in spark.read.parquet(out).select(
        "conv_id", "decision", "reject_reason", "reject_message").collect())
    exp = sorted(tuple(r) for r in mod.verdict(mod.explode_requests(reqs), model).collect())
    assert got == exp and len(got) == 12
    assert len([p for p in spark.read.parquet(out).inputFiles()]) >= 2


def test_scratch_folders_are_removed(spark):
    import os

    from tessera.session import scratch, shared_dir, write_once
    outer = shared_dir(spark, "scope")
    with scratch(spark):
        kept = write_once(spark.range(5).toDF("x"), "inner")
        files = kept.inputFiles()
        assert kept.count() == 5
        with scratch(spark):
            inner = shared_dir(spark, "scope")
            spark.range(2).write.parquet(inner)
        assert not os.path.exists(inner) and kept.count() == 5
    assert files and not any(os.path.exists(f.removeprefix("file://")) for f in files)
    spark.range(2).write.parquet(outer)
    assert spark.read.parquet(outer).count() == 2
