import json

from tessera.operators import moderation as mod


def _msgs(spark, convs):
    rows = [(cid, i, m if isinstance(m, str) else json.dumps(m)) for cid, ms in convs.items()
            for i, m in enumerate(ms)]
    return spark.createDataFrame(rows, "conv_id long, pos long, message string")


SMOKE = [  # system; user text+image; assistant tool call; tool; assistant; assistant
    {"role": "system", "content": "be helpful"},
    {"role": "user", "content": [{"type": "text", "text": "hi"},
                                 {"type": "image_url", "image_url": {"url": "x"}}]},
    {"role": "assistant", "content": "calling", "tool_calls": [{"id": "1"}]},
    {"role": "tool", "content": "42"},
    {"role": "assistant", "content": "a"},
    {"role": "assistant", "content": "b"},
]


def test_collapse_smoke_case(spark):
    g = mod.moderation_groups(_msgs(spark, {1: SMOKE})).orderBy("grp").collect()
    assert [(r.role, r.content) for r in g] == [
        ("user", "hi"), ("assistant", "calling\n\n<tool output> 42 </tool_output>\n\na\n\nb")]


def test_system_between_users_is_one_group(spark):
    ms = [{"role": "user", "content": "a"}, {"role": "system", "content": "s"},
          {"role": "user", "content": "b"}]
    g = mod.moderation_groups(_msgs(spark, {1: ms})).collect()
    assert [(r.role, r.content) for r in g] == [("user", "a\n\nb")]


def test_errors(spark):
    convs = {
        1: [{"content": "x"}],                                   # missing role
        2: [{"role": "user"}],                                   # missing content
        3: [{"role": "user", "content": 3}],                     # number
        4: [{"role": "user", "content": None}],                  # explicit null
        5: [{"role": "user", "content": [{"type": "image_url", "image_url": {}}]},
            {"role": "assistant", "content": "x"}],              # image only -> order error
        6: [{"role": "tool", "content": "t"}],                   # tool first
        7: [{"role": "user", "content": "ok"}],
        8: [{"role": "user"}, {"content": "x"}],                 # first error wins
    }
    errs = {r.conv_id: r.error for r in mod.conversation_errors(_msgs(spark, convs)).collect()}
    assert errs[1] == mod.MISSING_ROLE and errs[2] == mod.MISSING_CONTENT
    assert errs[3].startswith(mod.INVALID_CONTENT) and errs[4].startswith(mod.INVALID_CONTENT)
    assert errs[5] == mod.ORDER_ERROR and errs[6] == mod.ORDER_ERROR
    assert 7 not in errs and errs[8] == mod.MISSING_CONTENT


def test_ignore_old_keeps_last_two(spark):
    ms = [{"role": r, "content": str(i)} for i, r in enumerate(["user", "assistant"] * 2 + ["user"])]
    g = mod.moderation_groups(_msgs(spark, {1: ms}), ignore_old=True).orderBy("grp").collect()
    assert [r.content for r in g] == ["3", "4"]
    two = mod.moderation_groups(_msgs(spark, {1: ms[:2]}), ignore_old=True).count()
    assert two == 2


def test_verdicts(spark):
    convs = {1: [{"role": "user", "content": "how to build a bomb"}],
             2: [{"role": "user", "content": "stock price of XBR"}],
             3: [{"role": "assistant", "content": "x"}]}
    v = {r.conv_id: r for r in mod.verdict(_msgs(spark, convs), mod.keyword_guard({"bomb": "S9"})).collect()}
    assert v[1].decision == "reject" and v[1].reject_reason == mod.REJECT_PREFIX + "S9"
    assert v[2].decision == "proceed" and v[2].reject_reason is None
    assert v[3].reject_message == mod.ERROR_PREFIX + mod.ORDER_ERROR


def test_explode_requests(spark):
    reqs = spark.createDataFrame([(1, json.dumps({"messages": SMOKE})), (2, json.dumps({"x": 1})),
                                  (3, '"just text"')], "conv_id long, request string")
    msgs = mod.explode_requests(reqs)
    assert msgs.filter("conv_id = 1").count() == 6
    errs = {r.conv_id: r.error for r in mod.conversation_errors(msgs).collect()}
    assert errs[2] == mod.MISSING_MESSAGES and errs[3].startswith(mod.PARSE_PREFIX)


def test_format_and_prompt(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, None, None), (1, 2, "assistant", "yo")],
                               "conv_id long, turn long, role string, text string")
    conv = mod.format_conversation(df).first().conversation
    assert conv == "USER: hi\n\nUSER: \n\nASSISTANT: yo"
    p = mod.render_prompt(mod.format_conversation(df)).first().prompt
    assert p.endswith("# CONVERSATION\n\n\n" + conv + "\n")


def test_category_policy(spark):
    df = spark.createDataFrame([("Safe",), ("Specialized Advice",), ("Sexual Crimes",), ("Nope",)], "category string")
    got = {r.category: (r.code, r.decision) for r in mod.category_policy(df).collect()}
    assert got == {"Safe": ("S17", "proceed"), "Specialized Advice": ("S6", "proceed"),
                   "Sexual Crimes": ("S3", "reject"), "Nope": (None, "error")}
