"""Sentencepiece encoding and decoding with a distinct-chunk table.

If no piece has a whitespace marker after another character, no token crosses
the start of a run of markers, so a text is a sequence of marked words (markers
and what follows up to the next marker) that are segmented independently. The
same holds for line feeds if no piece of several characters has one. A task keeps
a table of the distinct marked words it has met; each is segmented once, and the
ids of a text are those of its words joined by position. Decoding joins the
pieces of the ids; sequences that a valid text can't give go through the library.
"""

from __future__ import annotations

import functools
import itertools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .common import prepare

MARKER = "▁"
#: Words that a task's table holds at most, and the characters of the longest one it holds.
TABLE_WORDS, TABLE_CHARS = 400_000, 64
#: Words that are looked up together, and bytes of text whose results are returned together.
GROUP, PART = 200_000, 4 << 20

#: After a space is put before the text: its marked words, or what follows a line feed.
WORD = re.compile(" +[^ \n]*|\n[^ \n]*")


def words_are_independent(model: sentencepiece_model_pb2.ModelProto) -> bool:
    """Whether tokens can't cross the start of a run of markers nor a line feed, and the
    model leaves texts as they are but for the markers."""
    kinds = type(model.pieces[0])
    spec, trained = model.normalizer_spec, model.trainer_spec
    pieces = [p.piece for p in model.pieces if p.type == kinds.NORMAL]
    return (trained.model_type == trained.BPE and trained.byte_fallback and not trained.treat_whitespace_as_suffix
            and spec.name == "identity" and not spec.precompiled_charsmap and spec.add_dummy_prefix
            and not spec.remove_extra_whitespaces and spec.escape_whitespaces
            and all(p.type in (kinds.NORMAL, kinds.BYTE, kinds.CONTROL, kinds.UNKNOWN) for p in model.pieces)
            and not any("\n" in p or re.search(f"[^{MARKER}]{MARKER}", p) for p in pieces))


class PieceCoder:
    """Encodes texts to ids and decodes ids to texts, as the library does."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        self.independent = words_are_independent(model)
        self.table: dict[str, bytes] = {}
        kinds = type(model.pieces[0])
        # bytes of each piece, a space for a marker; None for ids whose text the library gives
        self.pieces = [bytes([int(p.piece[1:-1], 16)]) if p.type == kinds.BYTE else
                       p.piece.replace(MARKER, " ").encode() if p.type == kinds.NORMAL else None for p in model.pieces]
        self.marked = [p.type == kinds.NORMAL and p.piece.startswith(MARKER) for p in model.pieces]

    # ------------------------------------------------------------------ encoding

    def _words(self, text: str):
        """The words of a text in lists of bounded length: a marked word without its first
        marker, or a line feed with what follows."""
        text = text.replace(MARKER, " ") if MARKER in text else text
        if "  " in text or text[0] == " " or len(text) > PART:
            found = (w[1:] if w[0] == " " else w for w in (m[0] for m in WORD.finditer(" " + text)))
            while part := list(itertools.islice(found, GROUP)):
                yield part
        else:
            yield text.replace("\n", " \n").split(" ")

    def _segment(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit bytes. The library puts a marker before
        each string; words after a line feed are told by that of the feed, which is a token."""
        found = self.library.encode(words, num_threads=1)
        out = []
        for w, ids in zip(words, found):
            if w == "":  # a marker alone
                ids = self.library.encode("\n")[:1]
            elif w[0] == "\n":  # the library's own marker before the feed goes
                ids = ids[1:]
            out.append(np.array(ids, "<i4").tobytes())
        return out

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """A table that has all the words; long ones are not kept for later."""
        table = self.table
        new = {w for w in words if w not in table}
        if not new:
            return table
        if len(table) + len(new) > TABLE_WORDS:
            table = self.table = {}
            new = set(words)
        listed = list(new)
        found = dict(zip(listed, self._segment(listed)))
        if any(len(w) > TABLE_CHARS for w in listed) or len(listed) > TABLE_WORDS:
            table.update(itertools.islice(((w, x) for w, x in found.items() if len(w) <= TABLE_CHARS), TABLE_WORDS))
            return {**table, **found}
        table.update(found)
        return table

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, "<i4")
        if not self.independent:
            return np.array(self.library.encode(text), "<i4")
        parts = []
        for words in self._words(text):
            table = self._learn(words)
            parts.append(b"".join(map(table.__getitem__, words)))
        return np.frombuffer(b"".join(parts), "<i4")

    # ------------------------------------------------------------------ decoding

    def decode(self, ids: np.ndarray) -> str:
        """The library's text of the ids."""
        if not len(ids):
            return ""
        listed = ids.tolist()
        try:
            text = b"".join(map(self.pieces.__getitem__, listed)).decode() if self.independent and min(listed) >= 0 else None
        except (TypeError, UnicodeDecodeError, IndexError):  # control ids, broken characters, unknown ids
            text = None
        if text is None:
            return self.library.decode(listed)
        return text[1:] if self.marked[listed[0]] else text  # the marker that encoding puts first


@functools.lru_cache(maxsize=2)
def _coder(path: str) -> PieceCoder:
    return PieceCoder(path)


def _spans(sizes, most: int):
    """(start, end) of neighbouring rows whose sizes sum up to about ``most``."""
    start, held = 0, 0
    for k, size in enumerate(sizes):
        held += size
        if held > most:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every row's whole text, as the library's
    ``encode`` gives them, without begin or end ids.

    A null text counts as empty and has no ids. Strings of special tokens inside a
    text are ordinary text. Null ids and repeated rows pass through, an empty table
    gives no rows, other columns are ignored. A text of any length is encoded
    whole, one at a time. ``model_path`` must be there on every worker.
    """
    prepare(docs.sparkSession)
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        coder = _coder(model_path)
        for b in batches:
            texts = b.column("text")
            for start, end in _spans(pc.binary_length(texts).fill_null(0).to_pylist(), PART):
                ids = [coder.encode(t) for t in texts.slice(start, end - start).to_pylist()]
                places = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]), pa.int32())
                flat = pa.array(np.concatenate([np.empty(0, "<i4"), *ids]), pa.int32())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(start, end - start),
                                                  pa.ListArray.from_arrays(places, flat)], ["doc_id", "ids"])

    return kept.mapInArrow(run, f"doc_id {dict(kept.dtypes)['doc_id']}, ids array<int>")


def decode_ids(tokens: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id``, ``ids`` and ``decoded``: the text of the ids, as the library's ``decode`` gives it.

    Null ids give an empty text, as an empty list does; a null within a list counts
    as id 0. Ids outside the vocabulary are an error, as in the library. Other columns are ignored.
    """
    prepare(tokens.sparkSession)
    kept = tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches):
        coder = _coder(model_path)
        for b in batches:
            lists = b.column("ids")
            for start, end in _spans(pc.list_value_length(lists).fill_null(0).to_pylist(), PART // 4):
                part = lists.slice(start, end - start)
                texts = [coder.decode(x.values.fill_null(0).to_numpy(zero_copy_only=False) if x.is_valid else np.empty(0, "<i4"))
                         for x in part]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(start, end - start), part, pa.array(texts, pa.string())],
                                                 ["doc_id", "ids", "decoded"])

    return kept.mapInArrow(run, f"doc_id {dict(kept.dtypes)['doc_id']}, ids array<int>, decoded string")


def round_trip_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Counts and digests of the ids of every text and of the text that they decode to."""
    both = decode_ids(encode_texts(docs, model_path), model_path)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
