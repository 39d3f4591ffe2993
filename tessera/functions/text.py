"""Text column helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed value: the characters Python's ``str.split()`` treats as whitespace, as
# a Java regex class (\s misses the information separators, NEL and the Unicode
# space separators).
UNICODE_WS = r"[\s\x1c-\x1f\x85\p{Z}]+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_ws(c) -> Column:
    """Collapse every run of Unicode whitespace to one space and strip the ends."""
    return F.trim(F.regexp_replace(_c(c), UNICODE_WS, " "))


def strip_ws(c) -> Column:
    """Remove all white space (Unicode's too, and the byte order mark) from both ends."""
    return F.regexp_replace(_c(c), r"^[\s\x{FEFF}\x85\p{Z}]+|[\s\x{FEFF}\x85\p{Z}]+$", "")


def join_pages(pages) -> Column:
    """Join an array of page texts with newlines; a null page becomes ''."""
    return F.array_join(F.transform(_c(pages), lambda p: F.coalesce(p, F.lit(""))), "\n")


def chat_title(text, ts=None, max_len: int = 50) -> Column:
    """First ``max_len`` characters of the trimmed text, plus '...' when longer;
    empty text gives 'New Chat <ts>' (``ts`` formatted yyyy-MM-dd HH:mm:ss)."""
    t = strip_ws(_c(text))
    cut = F.when(F.length(t) > max_len, F.concat(F.substring(t, 1, max_len), F.lit("..."))).otherwise(t)
    empty = F.concat(F.lit("New Chat "), F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss")) \
        if ts is not None else F.lit("New Chat")
    return F.when(t.isNull() | (F.length(t) == 0), empty).otherwise(cut)


def attachment_type(content_type) -> Column:
    """'image' when the content type starts with image/, otherwise 'text'."""
    return F.when(F.coalesce(_c(content_type).startswith("image/"), F.lit(False)), "image") \
        .otherwise("text")


def file_extension(filename) -> Column:
    """Text after the last '.', or '' when the name has none."""
    f = _c(filename)
    return F.when(f.contains("."), F.substring_index(f, ".", -1)).otherwise(F.lit(""))


def stored_name(id_col, filename) -> Column:
    """``<id>.<ext>``; the dot is kept when the name has no extension."""
    return F.concat(_c(id_col).cast("string"), F.lit("."), file_extension(filename))


def tag_speaker(text, name: str, only_nonempty: bool = True) -> Column:
    """``<name>{name}</name>`` + newline + text. With ``only_nonempty`` an empty
    or null text is returned unchanged (the retrieval speaker's rule); otherwise
    the tag is always added (null text counts as '')."""
    t = _c(text)
    tagged = F.concat(F.lit(f"<name>{name}</name>\n"), F.coalesce(t, F.lit("")))
    if not only_nonempty:
        return tagged
    return F.when(F.length(t) > 0, tagged).otherwise(t)


def tag_structured(first, last, name: str = "Structured Agent") -> Column:
    """The structured speaker's message: its tag, then the first and the last text of
    its answer, set apart by a blank line (one text counts as both)."""
    t = F.concat(F.coalesce(_c(first), F.lit("")), F.lit(" \n\n "), F.coalesce(_c(last), F.lit("")))
    return tag_speaker(t, name, only_nonempty=False)


def tool_text(role, content) -> Column:
    """Tool output as seen by the moderation model (tags as the model sees them)."""
    return F.when(_c(role) == "tool",
                  F.concat(F.lit("<tool output> "), _c(content), F.lit(" </tool_output>"))) \
        .otherwise(_c(content))
