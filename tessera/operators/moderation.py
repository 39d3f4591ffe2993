"""Conversation moderation as Spark jobs.

Input is one row per chat-completions message: ``(conv_id, pos, message)`` with
``message`` a JSON object text (``role``, ``content`` string or list of typed
parts, optional ``tool_calls``). Requests that carry a whole ``messages`` array
are first exploded by :func:`explode_requests`.

Steps, per conversation and for every conversation:

G1 validate + flatten: a message needs ``content`` then ``role``; string
   content gives one row, a list gives one row per ``text`` part (image parts are
   skipped), any other type (an explicit null included) is an error. The first
   error by (position, check order) wins.
G2 tool messages become assistant messages with tagged text.
G3 system messages are dropped (before run detection, so they do not split runs).
G4 consecutive same-role rows collapse into one group, texts joined by a blank line.
G5 group i must be user exactly when i is even.
G6 optionally keep the last two groups (only when more than two exist).
G8 a pluggable model scores the collapsed conversation.
G10 verdict: flagged -> reject + reason, error -> reject + message, else proceed.

Run detection uses :func:`~tessera.operators.ordering.runs` (a segmented scan
over range partitions), not a window per conversation, so a conversation
holding a large share of all messages is still processed by many tasks; per-conversation facts (error flag, group
count, order check) are partial aggregations joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.text import tool_text
from ..session import write_once
from .ordering import runs

# Error and verdict texts of the guardrail.
MISSING_MESSAGES = 'Missing key "messages" in request: {request}.'
MISSING_CONTENT = 'Missing key "content" in "messages": {request}.'
MISSING_ROLE = 'Missing key "role" in "messages": {request}.'
INVALID_CONTENT = 'Invalid value type for "content": '
INVALID_MESSAGES = 'Invalid value type for "messages": '  # our text: there the loop over it fails
ORDER_ERROR = ("Conversation roles must begin with either user role or a system role "
               "followed by a user role.")
REJECT_PREFIX = "Rejected due to following safety assessment: "
ERROR_PREFIX = "Errored with the following error message: "
PARSE_PREFIX = "Couldn't parse model input: "


def explode_requests(requests: DataFrame, id_col: str = "conv_id",
                     request_col: str = "request") -> DataFrame:
    """Request rows -> message rows ``(conv_id, pos, message, request_error, parse_error)``.

    Every request gives at least one row. A request that is not a JSON object,
    or one without ``messages``, gives one row with a null message and
    ``request_error`` set (``parse_error`` true for the former), and so does one
    whose ``messages`` is null or no list. An empty list gives one row with a
    null message and no error: nothing is left to moderate, and the model
    decides on an empty conversation.
    """
    v = requests.select(F.col(id_col).alias("conv_id"), F.expr(f"try_parse_json({request_col})").alias("_v"),
                        F.col(request_col).alias("_raw"))
    is_object = F.coalesce(F.expr("schema_of_variant(_v)").startswith("OBJECT"), F.lit(False))
    present = F.expr("try_variant_get(_v, '$.messages') IS NOT NULL")
    kind = F.expr("schema_of_variant(try_variant_get(_v, '$.messages'))")
    is_list = F.coalesce(kind.startswith("ARRAY"), F.lit(False))
    error = (F.when(~is_object, F.concat(F.lit(PARSE_PREFIX), F.coalesce("_raw", F.lit("None"))))
             .when(~present, F.lit(MISSING_MESSAGES))
             .when(~is_list, F.concat(F.lit(INVALID_MESSAGES), F.col("_raw"))))
    listed = F.when(error.isNull(), F.expr("try_variant_get(_v, '$.messages', 'array<variant>')"))
    return (v.select("conv_id", error.alias("request_error"), (~is_object).alias("parse_error"),
                     F.posexplode_outer(listed).alias("pos", "_m"))
            .select("conv_id", F.coalesce(F.col("pos").cast("long"), F.lit(-1).cast("long")).alias("pos"),
                    F.expr("to_json(_m)").alias("message"), "request_error", "parse_error"))


def flatten_messages(msgs: DataFrame) -> DataFrame:
    """G1: ``(conv_id, pos, part, role, text, error, check, parse_error)``.

    Valid rows have ``error`` null; an invalid message gives one row carrying its
    error; ``check`` orders the checks of one message (request, content, role,
    type, parts). Each message is parsed once and gives its rows by one generator.
    """
    given = set(msgs.columns)
    req_err = F.col("request_error") if "request_error" in given else F.lit(None).cast("string")
    parse_err = F.col("parse_error") if "parse_error" in given else F.lit(False)
    m = msgs.select("conv_id", "pos", F.expr("try_parse_json(message)").alias("_v"),
                    F.col("message").alias("_raw"), req_err.alias("_req_err"), parse_err.alias("parse_error"))
    m = (m.withColumn("_c", F.expr("try_variant_get(_v, '$.content')"))
          .withColumn("_ct", F.expr("schema_of_variant(_c)"))
          .withColumn("_has_role", F.expr("try_variant_get(_v, '$.role') IS NOT NULL"))
          .withColumn("role", F.expr("try_variant_get(_v, '$.role', 'string')")))
    # an empty request has a message row without a message: no error and nothing to moderate
    empty = F.col("_req_err").isNull() & F.col("_raw").isNull()
    row = "struct<part:int,text:string,error:string,check:int>"

    def one(part, text, error, check):
        return F.struct(part.cast("int").alias("part"), text.cast("string").alias("text"),
                        error.cast("string").alias("error"), check.cast("int").alias("check"))

    none, zero = F.lit(None), F.lit(0)
    parts = F.transform(F.expr("coalesce(try_variant_get(_c, '$', 'array<variant>'), array())"), lambda p, i: one(
        i, F.try_variant_get(p, "$.text", "string"),
        # a part without "type" fails the lookup; a text part without "text" too
        F.when(F.try_variant_get(p, "$.type", "string").isNull(), F.lit("'type'"))
         .when((F.try_variant_get(p, "$.type", "string") == "text") & F.try_variant_get(p, "$.text", "string").isNull(),
               F.lit("'text'")), F.lit(4)))
    parts = F.filter(F.zip_with(parts, F.transform(F.expr("coalesce(try_variant_get(_c, '$', 'array<variant>'), array())"),
                                                   lambda p: F.try_variant_get(p, "$.type", "string")),
                                lambda x, t: F.when(x["error"].isNotNull() | (t == "text"), x)), lambda x: x.isNotNull())
    rows = (F.when(empty, F.array().cast(f"array<{row}>"))
            .when(F.col("_req_err").isNotNull(), F.array(one(zero, none, F.col("_req_err"), F.lit(0))))
            .when(F.col("_ct").isNull(), F.array(one(zero, none, F.lit(MISSING_CONTENT), F.lit(1))))
            .when(~F.col("_has_role"), F.array(one(zero, none, F.lit(MISSING_ROLE), F.lit(2))))
            .when(F.col("_ct") == "STRING", F.array(one(zero, F.expr("try_variant_get(_c, '$', 'string')"), none, zero)))
            .when(F.col("_ct").startswith("ARRAY"), parts)
            .otherwise(F.array(one(zero, none, F.concat(F.lit(INVALID_CONTENT), F.col("_raw")), F.lit(3)))))
    return (m.select("conv_id", "pos", "role", "parse_error", F.explode(rows).alias("_r"))
            .select("conv_id", "pos", "_r.part", "role",
                    F.when(F.col("_r.error").isNull(), F.col("_r.text")).alias("text"), "_r.error", "_r.check", "parse_error"))


def first_errors(flat: DataFrame) -> DataFrame:
    """First validation error per conversation ``(conv_id, error, parse_error)``."""
    return (flat.filter(F.col("error").isNotNull())
            .groupBy("conv_id")
            .agg(F.min_by(F.struct("error", "parse_error"), F.struct("pos", "check", "part")).alias("_e"))
            .select("conv_id", "_e.error", "_e.parse_error"))


def collapse_roles(flat: DataFrame, ignore_system: bool = True, errors: DataFrame | None = None) -> DataFrame:
    """G2-G5 over valid rows: ``(conv_id, grp, role, content, n_groups, order_ok, valid)``.

    ``valid`` is false for a conversation with any G1 error; ``order_ok`` is the
    alternation check over the whole conversation. Runs are found with
    :func:`~tessera.operators.ordering.runs` (distributed positions, no
    per-conversation window), so one very long conversation is spread over
    many tasks; only each run's own text is gathered into one value.
    """
    if errors is None:
        errors = first_errors(flat)
    bad = errors.select("conv_id", F.lit(1).alias("_bad"))
    rows = flat.filter(F.col("error").isNull())
    rows = rows.withColumn("text", tool_text("role", "text")) \
               .withColumn("role", F.when(F.col("role") == "tool", "assistant").otherwise(F.col("role")))
    if ignore_system:
        rows = rows.filter(F.coalesce(F.col("role"), F.lit("")) != "system")
    # only the keys and roles are numbered; the text joins its run afterwards
    keys = runs(rows.select("conv_id", "pos", "part", "role"), ["conv_id"], ["pos", "part"], "role", "grp")
    rows = rows.drop("role").join(keys, ["conv_id", "pos", "part"])
    groups = (rows.groupBy("conv_id", "grp")
              .agg(F.first("role").alias("role"),
                   F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part", "text"))),
                                            lambda x: x["text"]), "\n\n").alias("content")))
    violation = (F.coalesce(F.col("role") == "user", F.lit(False)) != (F.col("grp") % 2 == 0)).cast("int")
    stats = groups.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_groups"),
                                          (F.max(violation) == 0).alias("order_ok"))
    return (groups.join(stats, "conv_id").join(bad, "conv_id", "left")
            .withColumn("valid", F.col("_bad").isNull()).drop("_bad"))


def _flat(msgs: DataFrame) -> DataFrame:
    """The flattened messages, parsed and written once: the errors, the runs and the
    texts are read from there."""
    return write_once(flatten_messages(msgs), "messages")


def moderation_groups(msgs: DataFrame, ignore_system: bool = True, ignore_old: bool = False) -> DataFrame:
    """Collapsed conversation groups ``(conv_id, grp, role, content)`` of every
    conversation that passes validation and the alternation check."""
    g = collapse_roles(_flat(msgs), ignore_system)
    g = g.filter(F.col("valid") & F.col("order_ok"))
    if ignore_old:
        g = g.filter((F.col("n_groups") <= 2) | (F.col("grp") >= F.col("n_groups") - 2))
    return g.select("conv_id", F.col("grp").cast("bigint").alias("grp"), "role", "content")


def _order_errors(groups: DataFrame) -> DataFrame:
    return (groups.filter(F.col("valid") & ~F.col("order_ok")).groupBy("conv_id")
            .agg(F.lit(ORDER_ERROR).alias("error"), F.lit(False).alias("parse_error")))


def conversation_errors(msgs: DataFrame, ignore_system: bool = True) -> DataFrame:
    """``(conv_id, error)``: the first validation error, else the order error."""
    flat = _flat(msgs)
    first = first_errors(flat)
    return first.unionByName(_order_errors(collapse_roles(flat, ignore_system, first))).select("conv_id", "error")


def keyword_guard(terms: dict[str, str]):
    """A rule model for tests and offline runs: a conversation is flagged when any
    of its groups contains one of ``terms`` (a whole word, any case); the reason
    is the category code of the first matching term in dict order."""
    def model(groups: DataFrame) -> DataFrame:
        hits = None
        for i, (term, code) in enumerate(terms.items()):
            pat = r"(?i)(^|[^\p{L}\p{N}])" + term + r"($|[^\p{L}\p{N}])"
            e = F.when(F.col("content").rlike(pat), F.lit(i))
            hits = e if hits is None else F.coalesce(hits, e)
        codes = F.array(*[F.lit(c) for c in terms.values()])
        return (groups.withColumn("_hit", hits).groupBy("conv_id")
                .agg(F.min("_hit").alias("_hit"))
                .select("conv_id", F.col("_hit").isNotNull().alias("flagged"),
                        F.when(F.col("_hit").isNotNull(), F.element_at(codes, F.col("_hit") + 1))
                         .alias("reason")))
    return model


def verdict(msgs: DataFrame, model, ignore_system: bool = True, ignore_old: bool = False) -> DataFrame:
    """G10 over every conversation: ``(conv_id, decision, reject_reason, reject_message)``.

    ``model(groups) -> (conv_id, flagged, reason)`` scores the collapsed groups
    of valid conversations (a conversation with no group left is scored by an
    empty input and comes back unflagged unless the model says otherwise).
    """
    flat = _flat(msgs)
    first = first_errors(flat)
    g = write_once(collapse_roles(flat, ignore_system, first), "groups")
    errs = first.unionByName(_order_errors(g))
    ok = g.filter(F.col("valid") & F.col("order_ok"))
    if ignore_old:
        ok = ok.filter((F.col("n_groups") <= 2) | (F.col("grp") >= F.col("n_groups") - 2))
    scored = model(ok.select("conv_id", F.col("grp").cast("bigint").alias("grp"), "role", "content"))
    convs = msgs.select("conv_id").distinct()
    j = convs.join(errs, "conv_id", "left").join(scored, "conv_id", "left")
    flagged = F.coalesce(F.col("flagged"), F.lit(False))
    return j.select(
        "conv_id",
        F.when(F.col("error").isNotNull() | flagged, "reject").otherwise("proceed").alias("decision"),
        F.when(F.col("error").isNull() & flagged, F.concat(F.lit(REJECT_PREFIX), F.col("reason")))
         .alias("reject_reason"),
        # input that is no request is reported as it is, an error of the checks with its prefix
        F.when(F.col("parse_error"), F.col("error"))
         .when(F.col("error").isNotNull(), F.concat(F.lit(ERROR_PREFIX), F.col("error"))).alias("reject_message"),
    )


def format_conversation(msgs: DataFrame, order_col: str = "turn", role_col: str = "role",
                        content_col: str = "text", key: str = "conv_id") -> DataFrame:
    """``ROLE: content`` lines (missing role -> user, missing content -> ''),
    blank-line separated in message order: ``(key, conversation)``."""
    line = F.concat(F.upper(F.coalesce(F.col(role_col), F.lit("user"))), F.lit(": "),
                    F.coalesce(F.col(content_col), F.lit("")))
    return (msgs.groupBy(key)
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order_col), line.alias("l")))),
                                          lambda x: x["l"]), "\n\n").alias("conversation")))


# Fixed value: the classifier's user prompt template.
USER_PROMPT = ("Provide your safety assessment in the specified JSON format for ONLY THE LAST message "
               "in the following conversation:\n\n# CONVERSATION\n\n\n{conversation}\n")


def render_prompt(df: DataFrame, col: str = "conversation", template: str = USER_PROMPT) -> DataFrame:
    """Fill the ``{conversation}`` slot of ``template`` (literal replace)."""
    before, _, after = template.partition("{conversation}")
    return df.withColumn("prompt", F.concat(F.lit(before), F.col(col), F.lit(after)))


def last_message(msgs: DataFrame, key: str = "conv_id", order_col: str = "turn") -> DataFrame:
    """The judged message: the last one of each conversation."""
    other = [c for c in msgs.columns if c not in (key,)]
    return (msgs.groupBy(key).agg(F.max_by(F.struct(*other), F.col(order_col)).alias("_m"))
            .select(key, "_m.*"))


# The 17 safety categories (code -> label) and the codes that count as safe.
CATEGORIES = [
    ("S1", "Violent Crimes"), ("S2", "Non-Violent Crimes"), ("S3", "Sexual Crimes"),
    ("S4", "Child Exploitation"), ("S5", "Defamation"), ("S6", "Specialized Advice"),
    ("S7", "Privacy"), ("S8", "Intellectual Property"), ("S9", "Indiscriminate Weapons"),
    ("S10", "Hate"), ("S11", "Self-Harm"), ("S12", "Sexual Content"), ("S13", "Elections"),
    ("S14", "Code Interpreter Abuse"), ("S15", "Prompt Injection"), ("S16", "Jailbreak"),
    ("S17", "Safe"),
]
SAFE_CODES = ("S6", "S17")


def category_policy(df: DataFrame, category_col: str = "category") -> DataFrame:
    """Map a classifier's category label to its code and a decision: the two safe
    categories proceed, the others reject; a label outside the enum is an error."""
    spark = df.sparkSession
    cats = spark.createDataFrame(CATEGORIES, "code string, label string")
    j = df.join(F.broadcast(cats), F.col(category_col) == cats.label, "left")
    return j.drop("label").withColumn(
        "decision", F.when(F.col("code").isNull(), "error")
        .when(F.col("code").isin(*SAFE_CODES), "proceed").otherwise("reject"))
