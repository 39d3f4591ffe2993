"""Conversation moderation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import moderation as mod
from ..sources.tables import load_table
from .catalog import register
from .moderation_inputs import MESSAGES_SQL, chat_messages_json

_W = "WITH " + MESSAGES_SQL

# Blocklist of the rule model used in place of a hosted guard model.
GUARD_TERMS = {"bomb": "S9", "kill": "S1", "hate": "S10", "password": "S7"}


def _q(s: str) -> str:
    return s.replace("'", "''")


@register("moderation_input", _W + """
SELECT c.conv_id, c.grp, c.role, c.content FROM c JOIN n USING (conv_id) WHERE NOT n.bad""")
def q_moderation_input(spark, sf_dir):
    return mod.moderation_groups(chat_messages_json(spark, sf_dir))


@register("moderation_last_two", _W + """
SELECT c.conv_id, c.grp, c.role, c.content FROM c JOIN n USING (conv_id)
WHERE NOT n.bad AND (n.n_groups <= 2 OR c.grp >= n.n_groups - 2)""")
def q_moderation_last_two(spark, sf_dir):
    return mod.moderation_groups(chat_messages_json(spark, sf_dir), ignore_old=True)


@register("alternation_errors", _W + f"""
SELECT conv_id, '{_q(mod.ORDER_ERROR)}' AS error FROM n WHERE bad""")
def q_alternation_errors(spark, sf_dir):
    return mod.conversation_errors(chat_messages_json(spark, sf_dir))


def _guard_sql() -> str:
    cases = " ".join(
        f"WHEN regexp_matches(content, '(?i)(^|[^\\p{{L}}\\p{{N}}]){t}($|[^\\p{{L}}\\p{{N}}])') THEN {i}"
        for i, t in enumerate(GUARD_TERMS))
    codes = ", ".join(f"'{c}'" for c in GUARD_TERMS.values())
    return f"""
, hit AS (SELECT c.conv_id, min(CASE {cases} END) AS h FROM c JOIN n USING (conv_id)
          WHERE NOT n.bad GROUP BY c.conv_id)
SELECT a.conv_id,
       CASE WHEN n.bad OR hit.h IS NOT NULL THEN 'reject' ELSE 'proceed' END AS decision,
       CASE WHEN NOT coalesce(n.bad, false) AND hit.h IS NOT NULL
            THEN '{_q(mod.REJECT_PREFIX)}' || [{codes}][hit.h + 1] END AS reject_reason,
       CASE WHEN n.bad THEN '{_q(mod.ERROR_PREFIX + mod.ORDER_ERROR)}' END AS reject_message
FROM (SELECT DISTINCT conv_id FROM conversations) a
LEFT JOIN n USING (conv_id) LEFT JOIN hit USING (conv_id)"""


@register("moderation_verdict", _W + _guard_sql())
def q_moderation_verdict(spark, sf_dir):
    return mod.verdict(chat_messages_json(spark, sf_dir), mod.keyword_guard(GUARD_TERMS))


@register("format_conversation", """
SELECT conv_id, string_agg(upper(coalesce(role, 'user')) || ': ' || coalesce(text, ''),
                           chr(10) || chr(10) ORDER BY turn) AS conversation
FROM conversations GROUP BY conv_id""")
def q_format_conversation(spark, sf_dir):
    return mod.format_conversation(load_table(spark, sf_dir, "conversations"))


_before, _, _after = mod.USER_PROMPT.partition("{conversation}")


@register("render_prompt", f"""
SELECT conv_id, conversation, '{_q(_before)}' || conversation || '{_q(_after)}' AS prompt
FROM (SELECT conv_id, string_agg(upper(coalesce(role, 'user')) || ': ' || coalesce(text, ''),
                                 chr(10) || chr(10) ORDER BY turn) AS conversation
      FROM conversations GROUP BY conv_id)""")
def q_render_prompt(spark, sf_dir):
    return mod.render_prompt(mod.format_conversation(load_table(spark, sf_dir, "conversations")))


@register("last_message", """
SELECT conv_id, turn, role, text FROM conversations
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1""")
def q_last_message(spark, sf_dir):
    return mod.last_message(load_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


_CATS = " ".join(f"WHEN '{_q(label)}' THEN '{code}'" for code, label in mod.CATEGORIES)


@register("category_policy", f"""
WITH cl AS (
  SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN 'Hate' WHEN l.quality = 0 THEN 'Specialized Advice'
                        WHEN d.lang = 'de' THEN 'Unlisted' ELSE 'Safe' END AS category
  FROM documents d JOIN labels l USING (doc_id))
SELECT doc_id, category, CASE category {_CATS} END AS code,
       CASE WHEN (CASE category {_CATS} END) IS NULL THEN 'error'
            WHEN (CASE category {_CATS} END) IN ('S6', 'S17') THEN 'proceed' ELSE 'reject' END AS decision
FROM cl""")
def q_category_policy(spark, sf_dir):
    d = load_table(spark, sf_dir, "documents").select("doc_id", "lang")
    lab = load_table(spark, sf_dir, "labels")
    cl = d.join(lab, "doc_id").select(
        "doc_id", F.when(F.col("toxic") == 1, "Hate").when(F.col("quality") == 0, "Specialized Advice")
        .when(F.col("lang") == "de", "Unlisted").otherwise("Safe").alias("category"))
    return mod.category_policy(cl)


@register("toxicity_scores")
def q_toxicity_scores(spark, sf_dir):
    """Default guard model trained on documents ⋈ labels, applied to the judged
    (last) group of every valid conversation."""
    from ..operators.classify import ml_guard, train_toxicity_model
    model = train_toxicity_model(load_table(spark, sf_dir, "documents"), load_table(spark, sf_dir, "labels"))
    groups = mod.moderation_groups(chat_messages_json(spark, sf_dir))
    last = mod.last_message(groups, key="conv_id", order_col="grp")
    return ml_guard(model)(last).select("conv_id", "grp", "first_token", "flagged", "reason", "p_toxic")


# Requests derived from conversations: each turn is a request of its own (well formed; an
# assistant's breaks the order), and gives one of these cases of the checks as another.
_CASES = ['{"x": 1}', '{"messages": null}', '{"messages": []}', '{"messages": "abc"}', '"just text"', '{oops',
          '{"messages": [{"content": "t"}]}', '{"messages": [{"role": "user"}]}',
          '{"messages": [{"role": "user", "content": null}]}', '{"messages": [{"role": "user", "content": 3}]}',
          '{"messages": [{"role": "user", "content": [{"text": "t"}]}]}',
          '{"messages": [{"role": "user", "content": [{"type": "text"}]}]}']
_CASE_ERRORS = [mod.MISSING_MESSAGES, mod.INVALID_MESSAGES + _CASES[1], None, mod.INVALID_MESSAGES + _CASES[3],
                mod.PARSE_PREFIX + _CASES[4], mod.PARSE_PREFIX + _CASES[5], mod.MISSING_ROLE, mod.MISSING_CONTENT,
                mod.INVALID_CONTENT + '{"content":null,"role":"user"}', mod.INVALID_CONTENT + '{"content":3,"role":"user"}',
                "'type'", "'text'"]


def _requests(spark, sf_dir):
    from ..functions.jsonfmt import json_string
    c = load_table(spark, sf_dir, "conversations").withColumn("n", F.col("conv_id") * 1000 + F.col("turn"))
    wrap = lambda role: F.concat(F.lit('{"messages": [{"role": "' + role + '", "content": '), json_string("text"), F.lit("}]}"))
    cases = F.array(*[F.lit(x) for x in _CASES])
    own = c.select((F.col("n") * 2).alias("conv_id"), F.when(F.col("role") == "assistant", wrap("assistant")).otherwise(wrap("user")).alias("request"))
    return own.unionByName(c.select((F.col("n") * 2 + 1).alias("conv_id"), F.element_at(cases, (F.col("n") % 12 + 1).cast("int")).alias("request")))


def _sql_text(x):
    return "NULL" if x is None else f"'{_q(x)}'"


_REQ_SQL = f"""
WITH t AS (SELECT conv_id * 1000 + turn AS n, role, text FROM conversations),
r AS (SELECT n * 2 AS conv_id, text, CASE WHEN role = 'assistant' THEN 13 ELSE 12 END AS k FROM t
      UNION ALL SELECT n * 2 + 1, text, n % 12 FROM t),
e AS (SELECT conv_id, text, k, CASE WHEN k < 12 THEN [{", ".join(map(_sql_text, _CASE_ERRORS))}][k + 1]
                                    WHEN k = 13 THEN '{_q(mod.ORDER_ERROR)}' END AS error FROM r)
"""


@register("request_errors", _REQ_SQL + "SELECT conv_id, error FROM e WHERE error IS NOT NULL")
def q_request_errors(spark, sf_dir):
    return mod.conversation_errors(mod.explode_requests(_requests(spark, sf_dir)))


_GUARD_CASES = " ".join(f"WHEN regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}]){t}($|[^\\p{{L}}\\p{{N}}])') THEN '{c}'"
                        for t, c in {**GUARD_TERMS, "the": "S6"}.items())
_VERDICT_SQL = _REQ_SQL + f"""
, v AS (SELECT *, CASE WHEN k = 12 THEN CASE {_GUARD_CASES} END END AS code FROM e)
SELECT conv_id, CASE WHEN error IS NOT NULL OR code IS NOT NULL THEN 'reject' ELSE 'proceed' END AS decision,
       '{_q(mod.REJECT_PREFIX)}' || code AS reject_reason,
       CASE WHEN k IN (4, 5) THEN error WHEN error IS NOT NULL THEN '{_q(mod.ERROR_PREFIX)}' || error END AS reject_message
FROM v"""


@register("request_verdict", _VERDICT_SQL)
def q_request_verdict(spark, sf_dir):
    return mod.verdict(mod.explode_requests(_requests(spark, sf_dir)), mod.keyword_guard({**GUARD_TERMS, "the": "S6"}))


# Requests of whole conversations: all messages of a conversation in one list, and the
# cases of the checks as further requests with negative ids.
def conversation_requests(spark, sf_dir):
    m = chat_messages_json(spark, sf_dir)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "message"))), lambda x: x["message"]), ",")
    whole = m.groupBy("conv_id").agg(F.concat(F.lit('{"messages":['), listed, F.lit("]}")).alias("request"))
    cases = spark.createDataFrame([(-1 - k, x) for k, x in enumerate(_CASES)], whole.schema)
    return whole.unionByName(cases)


def _case_message(k: int, error: str | None) -> str | None:
    return error if error is None or k in (4, 5) else mod.ERROR_PREFIX + error


CONVERSATION_VERDICT_SQL = f"SELECT * FROM ({_W}{_guard_sql()}) UNION ALL SELECT * FROM (VALUES " + ", ".join(
    f"({-1 - k}, '{'proceed' if e is None else 'reject'}', NULL, {_sql_text(_case_message(k, e))})"
    for k, e in enumerate(_CASE_ERRORS)) + ")"


@register("conversation_request_errors", f"""
SELECT * FROM ({_W} SELECT conv_id, '{_q(mod.ORDER_ERROR)}' AS error FROM n WHERE bad)
UNION ALL SELECT * FROM (VALUES """ + ", ".join(
    f"({-1 - k}, {_sql_text(e)})" for k, e in enumerate(_CASE_ERRORS) if e is not None) + ")")
def q_conversation_request_errors(spark, sf_dir):
    return mod.conversation_errors(mod.explode_requests(conversation_requests(spark, sf_dir)))


@register("conversation_request_verdict", CONVERSATION_VERDICT_SQL)
def q_conversation_request_verdict(spark, sf_dir):
    return mod.verdict(mod.explode_requests(conversation_requests(spark, sf_dir)), mod.keyword_guard(GUARD_TERMS))


_PROMPTS = f"""
WITH p AS (SELECT conv_id, '{_q(_before)}' || string_agg(upper(coalesce(role, 'user')) || ': ' || coalesce(text, ''),
                                                        chr(10) || chr(10) ORDER BY turn) || '{_q(_after)}' AS prompt
           FROM conversations GROUP BY conv_id),
k AS (SELECT conv_id, prompt, length(prompt) % 5 AS k FROM p)
"""


def _prompts(spark, sf_dir):
    return mod.render_prompt(mod.format_conversation(load_table(spark, sf_dir, "conversations"))).select("conv_id", "prompt")


def _two_step_model(prompts, max_tokens):
    """Stands in for a guard model: one token by the prompt's length, then a reason."""
    return [("safe" if len(p) % 5 else "unsafe") if max_tokens == 1 else f"S{len(p) % 17 + 1}" for p in prompts]


_TWO_STEP_SQL = _PROMPTS + """
SELECT conv_id, CASE WHEN k = 0 THEN 'unsafe' ELSE 'safe' END AS first_token, k = 0 AS flagged,
       CASE WHEN k = 0 THEN 'S' || ((length(prompt) + 6) % 17 + 1) END AS reason FROM k"""


@register("classify_two_step", _TWO_STEP_SQL)
def q_classify_two_step(spark, sf_dir):
    from ..operators.classify import classify
    return classify(_prompts(spark, sf_dir), _two_step_model)


@register("classify_loaded", _TWO_STEP_SQL)
def q_classify_loaded(spark, sf_dir):
    """The model is loaded once in each worker and asked 16 prompts at a time."""
    from ..operators.classify import classify, load_once
    return classify(_prompts(spark, sf_dir), load_once(lambda: _two_step_model), batch_size=16)


def _structured_model(prompts):
    """Stands in for a model with structured output; some answers are not valid."""
    return [['{"category": "Hate", "rationale": "r"}', '{"category": "Safe", "rationale": "fine"}', "no json",
             '{"category": "Other", "rationale": "r"}', '{"category": "Safe"}'][len(p) % 5] for p in prompts]


@register("classify_structured", _PROMPTS + """
SELECT conv_id, ['Hate', 'Safe', NULL, 'Other', 'Safe'][k + 1] AS category, ['r', 'fine', NULL, 'r', NULL][k + 1] AS rationale,
       ['S10', 'S17', NULL, NULL, 'S17'][k + 1] AS code, ['reject', 'proceed', NULL, NULL, NULL][k + 1] AS decision,
       [NULL, NULL, 'Invalid structured output', 'Unknown category: Other', 'Invalid structured output'][k + 1] AS error FROM k""")
def q_classify_structured(spark, sf_dir):
    from ..operators.classify import classify_structured
    return classify_structured(_prompts(spark, sf_dir), _structured_model)
