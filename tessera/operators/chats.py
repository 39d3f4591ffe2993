"""Chat tables: chats, messages, attachments as DataFrames, and their jobs.

Schemas: chats ``(id, title, user_id, user_email, user_name, created_at,
updated_at)``; messages ``(id, chat_id, content, role, created_at)``;
attachments ``(id, message_id, filename, stored_filename, file_path, file_type)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import attachment_type, chat_title, stored_name
from ..session import write_once
from .ordering import assign_ids, position_in_group

PAGE_DEFAULT, PAGE_MAX = 50, 100


def message_counts(chats: DataFrame, msgs: DataFrame) -> DataFrame:
    """``(id, message_count)`` for every chat, 0 when it has none."""
    counts = msgs.groupBy("chat_id").agg(F.count(F.lit(1)).alias("message_count"))
    return (chats.select("id").join(counts, chats.id == counts.chat_id, "left")
            .select("id", F.coalesce("message_count", F.lit(0)).cast("bigint").alias("message_count")))


def ordered_messages(msgs: DataFrame, chat_id=None) -> DataFrame:
    """Messages oldest first (tie: lower id), optionally of one chat."""
    m = msgs if chat_id is None else msgs.filter(F.col("chat_id") == F.lit(chat_id))
    return m.orderBy("chat_id", "created_at", "id")


def chat_with_messages(chats: DataFrame, msgs: DataFrame, atts: DataFrame) -> DataFrame:
    """Every chat with its messages (oldest first, tie lower id) and each message
    with its attachments (by id), as ordered rows:
    ``(chat_id, msg_pos, message_id, role, content, created_at, att_pos,
    attachment_id, filename, stored_filename, file_type)``.

    A chat without messages keeps one row with null message fields, a message
    without attachments one row with null attachment fields. Positions come from
    :func:`position_in_group`, so a chat of any size is spread over many tasks; only
    keys are numbered, the rest of a row joins by its (unique) id.
    Use :func:`nest_chat` to build the nested response shape per chat.
    """
    m = msgs.select(F.col("id").alias("message_id"), "chat_id", "role", "content", "created_at")
    m = m.join(position_in_group(m.select("message_id", "chat_id", "created_at"), ["chat_id"], ["created_at", "message_id"], "msg_pos")
               .select("message_id", "msg_pos"), "message_id")
    a = atts.select(F.col("id").alias("attachment_id"), "message_id", "filename", "stored_filename", "file_type")
    a = a.join(position_in_group(a.select("attachment_id", "message_id"), ["message_id"], ["attachment_id"], "att_pos")
               .select("attachment_id", "att_pos"), "attachment_id")
    # the large side stays on the left, where a hot chat can be split
    ids = chats.select(F.col("id").alias("chat_id"))
    ma = m.join(ids, "chat_id", "left_semi").join(a, "message_id", "left")
    bare = ids.join(m.select("chat_id").distinct(), "chat_id", "left_anti")
    return (ma.unionByName(bare, allowMissingColumns=True)
            .select("chat_id", "msg_pos", "message_id", "role", "content", "created_at", "att_pos",
                    "attachment_id", "filename", "stored_filename", "file_type"))


def nest_chat(rows: DataFrame) -> DataFrame:
    """Nested response shape ``(chat_id, messages array<struct<..., attachments>>)``
    from :func:`chat_with_messages` rows; meant for a page of chats (each chat's
    list is gathered in one row)."""
    att = F.when(F.col("attachment_id").isNotNull(),
                 F.struct(F.col("att_pos"), F.struct(F.col("attachment_id").alias("id"), "filename",
                                                      "stored_filename", "file_type").alias("a")))
    per_msg = (rows.groupBy("chat_id", "msg_pos", "message_id", "role", "content", "created_at")
               .agg(F.array_sort(F.collect_list(att)).alias("_a"))
               .withColumn("attachments", F.transform("_a", lambda x: x["a"])))
    m = F.when(F.col("message_id").isNotNull(), F.struct(
        "msg_pos", F.struct(F.col("message_id").alias("id"), "role", "content", "created_at",
                            "attachments").alias("m")))
    return (per_msg.groupBy("chat_id").agg(F.array_sort(F.collect_list(m)).alias("_m"))
            .select("chat_id", F.transform("_m", lambda x: x["m"]).alias("messages")))


def owned_by(requests: DataFrame, chats: DataFrame, chat_col: str = "chat_id",
             user_col: str = "user_id") -> DataFrame:
    """Requests ``(…, chat_id, user_id)`` whose chat belongs to that user; the
    others are 'not found' and drop out (a left semi join)."""
    own = chats.select(F.col("id").alias("_cid"), F.col("user_id").alias("_uid"))
    cond = (F.col(chat_col) == F.col("_cid")) & (F.col(user_col) == F.col("_uid"))
    return requests.join(own, cond, "left_semi")


def cascade_delete(chats: DataFrame, msgs: DataFrame, deleted: DataFrame,
                   atts: DataFrame | None = None) -> tuple[DataFrame, ...]:
    """Drop the chats listed in ``deleted`` (column ``id``), every message of those
    chats and, if ``atts`` is given, every attachment of those messages: returns
    (remaining chats, remaining messages[, remaining attachments])."""
    ids = deleted.select(F.col("id").alias("_del")).distinct()
    keep_chats = chats.join(ids, chats.id == ids._del, "left_anti")
    keep_msgs = msgs.join(ids, msgs.chat_id == ids._del, "left_anti")
    if atts is None:
        return keep_chats, keep_msgs
    gone = (msgs.select(F.col("id").alias("_mid"), "chat_id").join(ids, F.col("chat_id") == F.col("_del"), "left_semi")
            .select("_mid"))
    return keep_chats, keep_msgs, atts.join(gone, F.col("message_id") == F.col("_mid"), "left_anti")


def numbered_after(existing: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """``new`` with ids that follow the largest one of ``existing`` (1 if it is empty), in
    ``order``. Only the order's columns go through the numbering."""
    rows = write_once(new.withColumn("_r", F.monotonically_increasing_id()), "new_rows")
    keys = assign_ids(rows.select("_r", *order), [*order, "_r"], start=1, id_col="_n").select("_r", "_n")
    last = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_last"))  # one row
    return (rows.join(keys, "_r").join(F.broadcast(last))
            .withColumn("id", F.col("_last") + F.col("_n")).drop("_r", "_n", "_last"))


def append_messages(chats: DataFrame, msgs: DataFrame, new: DataFrame, order: list | None = None) -> tuple[DataFrame, DataFrame]:
    """Append ``new`` messages ``(chat_id, content, role, created_at, ...)``: returns (chats,
    messages). Messages of unknown chats are ignored, the others get the next
    ids in ``order`` (which must be unique) and bump their chat's ``updated_at``."""
    known = new.join(chats.select(F.col("id").alias("_cid")), F.col("chat_id") == F.col("_cid"), "left_semi")
    rows = numbered_after(msgs, known, order or ["created_at", "chat_id", "role", "content"])
    return apply_messages(chats, known), msgs.unionByName(rows.select(*msgs.columns))


def create_chats(chats: DataFrame, new: DataFrame, order: list) -> DataFrame:
    """Chats with ``new`` ones ``(title, user_id, user_email, user_name, created_at)``
    added; ids follow the largest one, ``updated_at`` is the creation time."""
    rows = numbered_after(chats, new, order).withColumn("updated_at", F.col("created_at"))
    cols = ["id", "title", "user_id", "user_email", "user_name", "created_at", "updated_at"]
    return chats.select(*cols).unionByName(rows.select(*cols))


def create_attachments(atts: DataFrame, files: DataFrame, order: list, upload_dir: str = "/uploads") -> DataFrame:
    """Attachments with those of ``files`` ``(message_id, filename, content_type)`` added."""
    rows = attachment_rows(numbered_after(atts, files, order), upload_dir)
    return atts.unionByName(rows.select(*atts.columns))


def user_chats_page(chats: DataFrame, skip: int = 0, limit: int = PAGE_DEFAULT,
                    user_id: str | None = None) -> DataFrame:
    """A page of each user's chats, newest ``updated_at`` first (tie: lower id).

    ``limit`` in 1..100 and ``skip`` >= 0 as the API enforces. The per-user
    ``row_number() <= skip + limit`` filter is planned as a window group limit:
    each partition keeps only its top rows per user before the shuffle.
    """
    if not 1 <= limit <= PAGE_MAX or skip < 0:
        raise ValueError("limit must be in 1..100 and skip >= 0")
    c = chats if user_id is None else chats.filter(F.col("user_id") == F.lit(user_id))
    w = Window.partitionBy("user_id").orderBy(F.col("updated_at").desc(), F.col("id").asc())
    return (c.withColumn("rank", F.row_number().over(w))
            .filter((F.col("rank") <= skip + limit) & (F.col("rank") > skip))
            .withColumn("rank", F.col("rank").cast("bigint")))


def chat_titles_from_messages(chats: DataFrame, msgs: DataFrame) -> DataFrame:
    """Title of each chat from its first user message (50 characters + '...'),
    or 'New Chat <created_at>' when there is none."""
    first = (msgs.filter(F.col("role") == "user").groupBy("chat_id")
             .agg(F.min_by("content", F.struct("created_at", "id")).alias("_first")))
    j = chats.select("id", "created_at").join(first, F.col("id") == F.col("chat_id"), "left")
    return j.select("id", chat_title(F.coalesce("_first", F.lit("")), F.col("created_at")).alias("title"))


def attachment_rows(files: DataFrame, upload_dir: str = "/uploads") -> DataFrame:
    """``(id, message_id, filename, content_type)`` -> attachment table rows."""
    stored = stored_name("id", "filename")
    return files.select("id", "message_id", "filename", stored.alias("stored_filename"),
                        F.concat(F.lit(upload_dir.rstrip("/") + "/"), stored).alias("file_path"),
                        attachment_type("content_type").alias("file_type"))


def apply_messages(chats: DataFrame, new_msgs: DataFrame) -> DataFrame:
    """Appending messages bumps their chat's ``updated_at`` to the newest one."""
    latest = new_msgs.groupBy("chat_id").agg(F.max("created_at").alias("_latest"))
    j = chats.join(latest, chats.id == latest.chat_id, "left")
    return j.select(*[F.col(c) for c in chats.columns if c != "updated_at"],
                    F.greatest("updated_at", "_latest").alias("updated_at"))


def apply_titles(chats: DataFrame, updates: DataFrame) -> DataFrame:
    """Rename upserts ``(chat_id, title, ts, seq)``: the latest update per chat
    (by ts, then seq) sets title and updated_at; unknown chat ids are ignored."""
    last = (updates.groupBy("chat_id")
            .agg(F.max_by(F.struct("title", "ts"), F.struct("ts", "seq")).alias("_u")))
    j = chats.join(last, chats.id == last.chat_id, "left")
    rest = [F.col(c) for c in chats.columns if c not in ("title", "updated_at")]
    return j.select(*rest, F.coalesce("_u.title", "title").alias("title"),
                    F.coalesce("_u.ts", "updated_at").alias("updated_at"))
