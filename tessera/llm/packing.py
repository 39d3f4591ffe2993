"""Packing of tokenised documents into windows by non-negative least squares.

Documents are cut at full windows, so that each leaves one shorter piece. Piece
lengths are rounded up to a grid; all combinations of up to three grid lengths
that fill a window exactly are the columns of a linear system whose right side
is the histogram of lengths. Non-negative least squares gives how often each
combination is used; the counts are rounded, and what is left is packed
greedily, all on the histogram (Krell et al., 2021). Spark numbers the pieces of
each length and deals them to the planned sequences.
"""

from __future__ import annotations

import base64
import functools
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import number_within, prepare, stored

WINDOW, END_ID = 2048, 1
#: Width of the length grid, and the most pieces of a combination.
GRID, DEPTH = 8, 3
#: Rows of one numbered block, and the least number of blocks for each length.
BLOCK_ROWS, LEAST_BLOCKS = 1_000_000, 256
#: Chunks whose ids a worker remembers; characters taken at a time.
REMEMBERED, SLICE = 300_000, 1 << 20

CHUNK = re.compile("[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")
#: White space beyond ASCII's six; it may join a run of white space with them.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Neighbours that make a chunk start or end with white space if only single spaces are split at.
UNEVEN = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ", " \x0b", "\x0b ", " \x0c", "\x0c ")


class ChunkTokenizer:
    """Token ids of whole texts as little-endian 32-bit bytes.

    The tokenizer splits a text before merging, and never across the start of a
    run of white space, so a chunk (white space and what follows up to the next)
    has the same ids wherever it stands. Chunks are encoded once by the rank file
    of the same vocabulary and remembered. Texts with other white space or with a
    special token's string go through the tokenizer as they are.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        self.whole = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.ranks = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.feed = self.ranks.encode_ordinary("\n")[0]
        self.after_space: dict[str, bytes] = {}  # chunk of one space and the key
        self.plain: dict[str, bytes] = {}

    def _learn(self, known: dict[str, bytes], keys, before: str) -> None:
        new = {k for k in keys if k not in known}
        if not new:
            return
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set(keys)
        simple = [k for k in new if "\n" not in k]
        if simple and before:
            # a line feed before a space is a token by itself, so it marks the chunks' starts
            ids = np.array(self.ranks.encode_ordinary("".join(f"\n{before}{k}" for k in simple)), dtype="<u4")
            at = np.flatnonzero(ids == self.feed).tolist() + [len(ids)]
            raw = ids.tobytes()
            known.update((k, raw[4 * a + 4:4 * b]) for k, a, b in zip(simple, at[:-1], at[1:], strict=True))
            new.difference_update(simple)
        for k in new:
            known[k] = np.array(self.ranks.encode_ordinary(before + k), dtype="<u4").tobytes()

    def encode(self, text: str):
        """The ids of a text, in parts."""
        if not text:
            return
        if OTHER_SPACE.search(text) or any(s in text for s in self.special):
            yield np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        elif text[0].isspace() or text[-1].isspace() or any(x in text for x in UNEVEN):
            chunks = CHUNK.finditer(text)
            while part := [m[0] for m in itertools.islice(chunks, 100_000)]:
                self._learn(self.plain, part, "")
                yield b"".join(map(self.plain.__getitem__, part))
        else:
            start = 0
            while start < len(text):
                end = text.find(" ", start + SLICE)
                end = len(text) if end < 0 else end
                words = text[start:end].split(" ")
                if start == 0:
                    self._learn(self.plain, words[:1], "")
                    yield self.plain[words[0]]
                words = words[1:]
                self._learn(self.after_space, words, " ")
                yield b"".join(map(self.after_space.__getitem__, words))
                start = end

    def pieces(self, text: str | None):
        """(start, length, crc32) of each piece, and the number of ids with the end id."""
        out, start, rest = [], 0, b""
        for part in itertools.chain(self.encode(text or ""), [END_ID.to_bytes(4, "little")]):
            rest += part
            whole = len(rest) // (4 * WINDOW)
            for k in range(whole):
                out.append((start, WINDOW, zlib.crc32(rest[4 * WINDOW * k:4 * WINDOW * (k + 1)])))
                start += WINDOW
            rest = rest[4 * WINDOW * whole:]
        if rest:
            out.append((start, len(rest) // 4, zlib.crc32(rest)))
        return out, start + len(rest) // 4


@functools.lru_cache(maxsize=2)
def _tokenizer(json_path: str, ranks_path: str, pattern: str) -> ChunkTokenizer:
    return ChunkTokenizer(json_path, ranks_path, pattern)


def document_pieces(docs: DataFrame, json_path: str, ranks_path: str, pattern: str,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``start``, ``length``, ``ids_crc32`` and ``doc_tokens`` of each piece."""
    prepare(docs.sparkSession)
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        tokenizer = _tokenizer(json_path, ranks_path, pattern)
        for b in batches:
            at, rows = [], []
            for k, text in enumerate(b.column("text")):
                found, total = tokenizer.pieces(text.as_py())
                at += [k] * len(found)
                rows += [(*f, total) for f in found]
            columns = np.array(rows, dtype=np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), *map(pa.array, columns)],
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return kept.mapInArrow(run, f"doc_id {dict(kept.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long")


def combinations(units: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """All falling sequences of up to ``depth`` lengths (in grid units) whose sum fills the window."""
    def below(left: int, most: int, parts: int):
        if left == 0:
            yield ()
        elif parts:
            for first in range(min(left, most), -(-left // parts) - 1, -1):
                for others in below(left - first, first, parts - 1):
                    yield (first, *others)
    return list(below(units, units, depth))


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 with least |a x - b| by the active-set method of Lawson and Hanson."""
    x, free = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    tolerance = 1e-6 * float(np.abs(a.T @ b).max(initial=0))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[free] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= tolerance:
            break
        free[best] = True
        while True:
            at = np.flatnonzero(free)
            own = a[:, at]
            z = np.linalg.solve(own.T @ own + 1e-10 * np.eye(len(at)), own.T @ b)
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            low = z <= 0
            step = float(np.min(x[at][low] / np.maximum(x[at][low] - z[low], 1e-300)))
            x[at] += step * (z - x[at])
            drop = at[low & (x[at] <= 1e-12)] if step else at[low]
            free[drop], x[drop] = False, 0
            if not free.any():
                break
    return x


def plan_packing(histogram: dict[int, int], units: int = WINDOW // GRID) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in grid units) and how many sequences follow each. All pieces
    of the histogram are placed, whatever the solution of the least squares."""
    left = np.zeros(units + 1, dtype=np.int64)
    for length, n in histogram.items():
        left[length] = n
    plan = [((units,), int(left[units]))] if left[units] else []
    left[units] = 0
    columns = [c for c in combinations(units) if len(c) > 1 and left[list(c)].all()]
    if columns:
        a = np.zeros((units + 1, len(columns)))
        for j, c in enumerate(columns):
            np.add.at(a[:, j], list(c), 1)
        # short pieces that stay over fill gaps, so their residuals weigh less
        weight = np.where(np.arange(units + 1) >= units // 4, 1.0, 0.2)
        repeats = nnls(a * weight[:, None], left * weight)
        for j in np.argsort(-repeats, kind="stable"):
            c = columns[j]
            n = min(round(float(repeats[j])), *(int(left[k]) // c.count(k) for k in set(c)))
            if n > 0:
                plan.append((c, n))
                np.subtract.at(left, list(c), n)
    while left.any():
        pattern, room, free = [], units, left.copy()
        while room and (fit := np.flatnonzero(free[:room + 1])).size:
            pattern.append(int(fit[-1]))
            free[fit[-1]] -= 1
            room -= fit[-1]
        n = min(int(left[k]) // pattern.count(k) for k in set(pattern))
        plan.append((tuple(pattern), n))
        np.subtract.at(left, pattern, n)
    return plan


def pack(pieces: DataFrame) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces of 1 to 2048 ids (column ``length``).

    No sequence is longer than the window, offsets have no gaps, and every row is
    placed. The driver gets one count for each grid length. Rows may repeat and
    have nulls in other columns; an empty table gives no rows.
    """
    rows = stored(pieces.withColumn("_row", F.monotonically_increasing_id())
                  .withColumn("_units", F.ceil(F.col("length") / GRID).cast("int")), "pieces")
    spark = rows.sparkSession
    sizes = {r["_units"]: r["count"] for r in rows.groupBy("_units").count().collect()}
    ranges, first, taken = [], 0, dict.fromkeys(sizes, 0)
    for pattern, n in plan_packing(sizes):
        for k in dict.fromkeys(pattern):
            times = pattern.count(k)
            ranges.append((k, taken[k], taken[k] + times * n, first, times))
            taken[k] += times * n
        first += n
    # a few rows for each pattern; patterns are bounded by the grid, not by the data
    plan = spark.createDataFrame(ranges, "_units int, _low long, _high long, _first long, _times long")
    blocks = max(LEAST_BLOCKS, sum(sizes.values()) // BLOCK_ROWS)
    numbered = number_within(rows, ["_units"], F.pmod(F.xxhash64("_row"), F.lit(blocks)), [F.col("_row")], "_number")
    placed = (numbered.join(F.broadcast(plan), "_units")
              .where((F.col("_number") >= F.col("_low")) & (F.col("_number") < F.col("_high")))
              .withColumn("sequence_id", F.col("_first") + F.floor((F.col("_number") - F.col("_low")) / F.col("_times"))))
    before = (Window.partitionBy("sequence_id").orderBy(F.desc("length"), "_row")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
            .select(*pieces.columns, "sequence_id", "offset"))


def pack_documents(docs: DataFrame, json_path: str, ranks_path: str, pattern: str) -> DataFrame:
    """The pieces of all documents with their places.

    A null or empty text is the end id alone. Null ids and repeated rows are
    documents like any other; further columns are ignored.
    """
    return pack(document_pieces(docs, json_path, ranks_path, pattern))
