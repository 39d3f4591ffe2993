from tessera.operators import classify as cl


def test_two_step_classify(spark):
    calls = []

    def model_fn(prompts, max_tokens):
        calls.append(max_tokens)
        if max_tokens == 1:
            return ["unsafe" if "bad" in p else "safe" for p in prompts]
        return ["\nS1" for _ in prompts]

    df = spark.createDataFrame([(1, "bad thing"), (2, "fine")], "id long, prompt string")
    got = {r.id: (r.first_token, r.flagged, r.reason) for r in cl.classify(df, model_fn).collect()}
    assert got == {1: ("unsafe", True, "\nS1"), 2: ("safe", False, None)}


def test_ml_guard_learns(spark):
    docs = spark.createDataFrame([(i, ("hate hate awful" if i % 2 else "lovely calm day")) for i in range(40)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    guard = cl.ml_guard(cl.train_toxicity_model(docs, labels, dim=256))
    probe = spark.createDataFrame([(1, "awful hate"), (2, "calm lovely")], "id long, content string")
    got = {r.id: r.flagged for r in guard(probe).collect()}
    assert got == {1: True, 2: False}


def test_model_is_loaded_once_a_worker_and_asked_in_batches(spark):
    loads = spark.sparkContext.accumulator(0)

    def load():
        def model(prompts, max_tokens):
            assert 0 < len(prompts) <= 7
            return ["unsafe" if p.endswith("3") else "safe" for p in prompts] if max_tokens == 1 else ["S1"] * len(prompts)
        return model

    model = cl.load_once(load, loads)
    df = spark.range(300).selectExpr("id", "cast(id as string) AS prompt").repartition(12)
    for _ in range(2):  # the workers of the first job keep the model for the second
        got = {r.id: (r.flagged, r.reason) for r in cl.classify(df, model, batch_size=7).collect()}
        assert got == {k: (k % 10 == 3, "S1" if k % 10 == 3 else None) for k in range(300)}
    assert 1 <= loads.value <= 4


def test_structured_output_in_batches(spark):
    df = spark.range(20).selectExpr("id", "cast(id as string) AS prompt").coalesce(1)
    fn = lambda prompts: ['{"category": "Safe", "rationale": "%d"}' % len(prompts)] * len(prompts)
    assert {r.rationale for r in cl.classify_structured(df, fn, batch_size=8).collect()} == {"8", "4"}
