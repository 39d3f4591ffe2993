import json

from pyspark.sql import functions as F

from tessera.operators import messages as msg

D, DONE, OTHER = msg.TEXT_DELTA, msg.ITEM_DONE, "response.created"


def _events(spark, evs):
    rows = [(1, i, t, iid, d, txt) for i, (t, iid, d, txt) in enumerate(evs)]
    return spark.createDataFrame(rows, "request_id long, seq long, type string, item_id string, "
                                       "delta string, text string")


def test_merge_deltas_cases(spark):
    evs = [(D, "a", "he", None), (D, "b", "llo", None), (DONE, "c", None, "tool"), (D, "d", "x", None)]
    out = [(r.kind, r.item_id, r.text) for r in msg.merge_deltas(_events(spark, evs)).orderBy("out_pos").collect()]
    assert out == [("delta", "a", "hello"), ("done", "c", "tool"), ("delta", "d", "x")]
    evs = [(D, "a", "1", None), (OTHER, None, None, None), (D, "z", "2", None)]
    out = [(r.item_id, r.text) for r in msg.merge_deltas(_events(spark, evs)).collect()]
    assert out == [("a", "12")]


def _items(spark, items):
    return spark.createDataFrame([(1, i, json.dumps(x)) for i, x in enumerate(items)],
                                 "conv_id long, pos long, item string")


def test_to_chat_messages(spark):
    items = [
        {"type": "function_call", "call_id": "c1", "name": "f", "arguments": '{"a": 1}'},
        {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "p1"},
                                                        {"type": "input_text", "text": "p2"}]},
        {"type": "function_call_output", "call_id": "c1", "output": "42"},
        {"role": "assistant", "content": "", "tool_calls": [{"id": "x"}], "extra": 1},
        {"type": "reasoning", "summary": "s"},                       # nothing allow-listed
        {"role": "user", "content": "plain", "name": None},
    ]
    rows = msg.to_chat_messages(_items(spark, items)).orderBy("pos", "sub").collect()
    got = [(r.pos, r.sub, r.role, r.content, r.tool_call_id) for r in rows]
    assert got == [(0, 0, "assistant", "tool call", None), (1, 0, "user", "p1", None), (1, 1, "user", "p2", None),
                   (2, 0, "tool", "42", "c1"), (3, 0, "assistant", "tool call", None), (5, 0, "user", "plain", None)]
    assert json.loads(rows[0].tool_calls) == [{"id": "c1", "type": "function",
                                               "function": {"arguments": '{"a": 1}', "name": "f"}}]


def test_to_response_items(spark):
    ms = [
        {"role": "assistant", "content": "thinking", "id": "m1",
         "tool_calls": [{"id": "t1", "function": {"name": "f", "arguments": '{"x": "é"}'}},
                        {"id": "t2", "function": {"name": "g", "arguments": "{}"}}]},
        {"role": "assistant", "content": "  ", "id": "m2", "tool_calls": [{"id": "t3", "function": {"name": "h", "arguments": "{}"}}]},
        {"role": "assistant", "content": "final"},
        {"role": "tool", "content": "out", "tool_call_id": "t1"},
        {"role": "human", "content": "hi"},
        {"role": "user", "content": "bad"},
    ]
    df = spark.createDataFrame([(1, i, json.dumps(x)) for i, x in enumerate(ms)], "conv_id long, pos long, message string")
    rows = msg.to_response_items(df).orderBy("pos", "item_pos").collect()
    assert [(r.pos, r.type) for r in rows] == [(0, "message"), (0, "function_call"), (0, "function_call"),
                                              (1, "function_call"), (2, "message"), (3, "function_call_output"),
                                              (4, None), (5, None)]
    assert json.loads(rows[1].arguments) == '{"x": "é"}'      # encoded once more
    assert rows[4].item_id and rows[4].item_id.startswith("msg_")
    assert rows[7].error == "unsupported role: user" and rows[6].text == "hi"


def test_response_text(spark):
    cases = [('{"choices":[{"message":{"content":"A"}}]}', "A"), ('{"content":"B"}', "B"), ('"C"', "C"),
             ('{"other":1}', '{"other":1}'), (None, msg.FALLBACK_TEXT), ('{"choices":[]}', msg.FALLBACK_TEXT)]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(cases)], "i int, response string")
    got = [r.t for r in msg.response_text(df, out="t").orderBy("i").collect()]
    assert got == [e for _, e in cases]


def test_validate_arguments(spark):
    schema = {"properties": {"n": {"type": "integer"}, "b": {"type": "boolean"}, "s": {}}, "required": ["n", "s"]}
    df = spark.createDataFrame([(1, '{"n": 3, "s": "x", "b": true}'), (2, '{"n": "z", "b": "maybe"}'), (3, "nope")],
                               "id int, a string")
    rows = {r.id: r for r in msg.validate_arguments(df, "a", schema).collect()}
    assert rows[1].n == 3 and rows[1].b is True and rows[1].errors == []
    assert sorted(rows[2].errors) == ["b: not a valid boolean", "n: not a valid bigint", "s: field required"]
    assert rows[3].errors == ["arguments: invalid JSON object"]


def test_filter_stream_events(spark):
    ev = spark.createDataFrame([
        ("updates", "search", "assistant", "u1", None), ("updates", "response_agent", "assistant", "u2", None),
        ("messages", "response_agent", "assistant", "m1", None),
        ("messages", "response_agent", "assistant", "m2", '[{"id":1}]'),
        ("messages", "search", "assistant", "m3", None)], "mode string, node string, role string, content string, "
                                                           "tool_calls string")
    assert sorted(r.content for r in msg.filter_stream_events(ev).collect()) == ["m1", "u1"]


def test_conversation_payload(spark):
    df = spark.createDataFrame([(1, 2, "b", "assistant", 5), (1, 1, "a", "user", 5)],
                               "chat_id long, id long, content string, role string, created_at long")
    p = json.loads(msg.conversation_payload(df).first().payload)
    assert p == {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}
