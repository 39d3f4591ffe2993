"""Documents that hold a benchmark item, by the q-gram lemma on diagonal bands.

An occurrence of an item of n characters with at most k edits shares at least
n - q + 1 - q k of its q-grams with the document, on at most k + 1 neighbouring
diagonals (document position less item position). Shared q-grams are counted in
bands of diagonals that overlap by half and are at least twice that wide, so
each occurrence lies in one band whole. Bands that meet the bound are kept and
verified by banded alignment (Ukkonen; Jokinen; Rasmussen et al., 2006). Short items
have shorter q-grams, so that the bound stays positive for all their edits; items
too short for any edit and q-gram are found as whole words.
"""

from __future__ import annotations

import functools
import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import prepare, stored

#: Characters of a q-gram: of items of at least ``LONG`` characters, and of shorter ones. Items of
#: fewer than ``SHORT`` characters are searched as they are, from word border to word border.
Q, SHORT_Q, LONG, SHORT = 8, 5, 32, 8
#: Edits that an occurrence may have, as a share of the item's characters.
ERROR = 0.1
#: Characters of benchmark items that one pass over the documents holds (on average).
BLOCK_CHARS = 4_000_000
#: Characters of documents that are taken together.
SLICE = 1 << 20
FILTER_BITS = 22


@functools.cache
def _folded() -> np.ndarray:
    """Each code point in lower case, if a letter or digit, else a space."""
    out = np.full(sys.maxunicode + 1, 32, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        x = chr(c)
        if x.isalnum():
            out[c] = ord(x.lower()) if len(x.lower()) == 1 else c
    return out


def normalized(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters, with runs of others as one space, and their places in the text."""
    points = _folded()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    word = points != 32
    keep = word.copy()
    keep[1:] |= word[:-1]
    at = np.flatnonzero(keep)
    if len(at) and not word[at[-1]]:
        at = at[:-1]
    return points[at], at


def _hashes(points: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit hash of the q-gram that starts at each place."""
    if len(points) < q:
        return np.empty(0, np.uint64)
    single = code = points.astype(np.uint64)
    size, factors = 1, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
    for factor in factors:  # doubled as far as it goes
        if 2 * size <= q:
            code = code[:-size] * np.uint64(factor) + code[size:]
            code ^= code >> np.uint64(29)
            size *= 2
    while size < q:
        code = code[:-1] * np.uint64(factors[0]) + single[size:]
        code ^= code >> np.uint64(29)
        size += 1
    return code * np.uint64(0xD6E8FEB86659FD93)


class Grams:
    """The q-grams of items, for one length ``q``; ``own`` are the items' numbers in the index."""

    def __init__(self, q: int, own: np.ndarray, items: list[np.ndarray], edits: np.ndarray):
        self.q, self.own, self.items, self.edits = q, own, items, edits
        sizes = np.array([len(p) for p in items], dtype=np.int64)
        self.need = sizes - q + 1 - q * edits
        self.step = np.maximum(edits + 1, 16)
        hashes = [_hashes(p, q) for p in items]
        every = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.grams, first = np.unique(every[order], return_index=True)  # sorted distinct hashes
        self.first = np.append(first, len(every))  # places of a hash's entries
        self.seen = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.seen[(self.grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        owner = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.empty(0, np.int64)
        self.entry_item, self.entry_at = owner[order].astype(np.int64), place[order].astype(np.int64)

    @property
    def reach(self) -> int:
        """The most characters that an occurrence's bands span."""
        return max((len(p) + int(k) + 2 * int(s) for p, k, s in zip(self.items, self.edits, self.step)), default=0)


@dataclass
class Index:
    """A block of distinct normalised items: ``ids`` and ``counts`` have an id (the least) and the
    number of the benchmark's rows with each text."""

    items: list[np.ndarray]
    ids: list
    counts: list[int]
    edits: np.ndarray
    parts: list[Grams]
    words: dict[int, dict[bytes, int]]  # the shortest items, by length


def build_index(rows: list[tuple], error: float = ERROR) -> Index:
    """Index items: (id, text) or (id, text, number of rows). One without letters and digits is left out."""
    by_text: dict[bytes, list] = {}
    for item_id, text, *n in rows:
        points, _ = normalized(text or "")
        if len(points):
            entry = by_text.setdefault(points.tobytes(), [points, item_id, 0])
            if item_id is not None and (entry[1] is None or item_id < entry[1]):
                entry[1] = item_id
            entry[2] += n[0] if n else 1
    items, ids, counts = [[e[k] for e in by_text.values()] for k in range(3)]
    sizes = np.array([len(p) for p in items], dtype=np.int64)
    edits = np.where(sizes < SHORT, 0, (sizes * error).astype(np.int64))
    parts = []
    for q, own in ((Q, sizes >= LONG), (SHORT_Q, (sizes >= SHORT) & (sizes < LONG))):
        own = np.flatnonzero(own)
        # never more edits than leave one shared q-gram (with more errors than ERROR)
        edits[own] = np.minimum(edits[own], (sizes[own] - q) // q)
        if len(own):
            parts.append(Grams(q, own, [items[i] for i in own], edits[own]))
    words: dict[int, dict[bytes, int]] = {}
    for i in np.flatnonzero(sizes < SHORT):
        words.setdefault(int(sizes[i]), {})[items[i].tobytes()] = int(i)
    return Index(items, ids, counts, edits, parts, words)


def candidate_bands(index: Grams, points: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, band) of the bands that meet the bound. ``points`` are several
    documents on end, ``doc`` the number of each character's document. Band b of an
    item takes the diagonals from b to b + 2 steps, counted from the first character."""
    none = np.empty(0, np.int64)
    h = _hashes(points, index.q)
    if not len(h) or not len(index.grams):
        return none, none, none
    at = np.flatnonzero(index.seen[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
    at = at[doc[at] == doc[at + index.q - 1]]
    gram = np.searchsorted(index.grams, h[at])
    gram[gram == len(index.grams)] = 0
    hit = index.grams[gram] == h[at]
    at, gram = at[hit], gram[hit]
    # one row for each entry of each q-gram, a bounded number of rows at a time
    counts = index.first[gram + 1] - index.first[gram]
    items, n_items = len(index.items), np.int64(len(index.items))
    base = int(doc[0]) if len(doc) else 0
    documents = int(doc[-1]) - base + 1
    total = np.zeros(documents * items, np.int64) if documents * items <= 1 << 24 else None
    cells = []
    ends = np.cumsum(counts)
    for turn in (0, 1) if total is not None else (1,):
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 21), side="right")))
            c, g = counts[lo:hi], gram[lo:hi]
            entry = np.repeat(index.first[g] - (np.cumsum(c) - c), c) + np.arange(c.sum())
            where = np.repeat(at[lo:hi], c)
            item = index.entry_item[entry]
            pair = (doc[where] - base) * n_items + item
            if turn == 0:
                total += np.bincount(pair, minlength=len(total))
            else:
                if total is not None:  # documents with too few shared q-grams of an item
                    some = total[pair] >= index.need[item]
                    entry, where, item, pair = entry[some], where[some], item[some], pair[some]
                band = (where - index.entry_at[entry]) // index.step[item] + (1 << 20)
                cells.append(np.unique(pair << 32 | band, return_counts=True))
            lo = hi
    if not cells:
        return none, none, none
    key, back = np.unique(np.concatenate([k for k, _ in cells]), return_inverse=True)
    n = np.bincount(back, weights=np.concatenate([c for _, c in cells])).astype(np.int64)
    # a band is a cell and the next one
    starts = np.unique(np.concatenate([key, key - 1]))

    def count(k):
        where = np.minimum(np.searchsorted(key, k), len(key) - 1)
        return np.where(key[where] == k, n[where], 0)

    item = (starts >> 32) % n_items
    good = count(starts) + count(starts + 1) >= index.need[item]
    starts, item = starts[good], item[good]
    return (starts >> 32) // n_items + base, item, (starts & ((1 << 32) - 1)) - (1 << 20)


def banded_distances(item: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of the item to a substring of each window, and where it ends.

    Row w of ``windows`` holds len(item) + width - 1 characters; an alignment may
    run on any of its ``width`` diagonals.
    """
    n = len(item)
    width = windows.shape[1] - n + 1
    slope = np.arange(width, dtype=np.int32)
    cost = np.zeros((len(windows), width), dtype=np.int32)
    for j in range(n):
        now = cost + (windows[:, j:j + width] != item[j])
        now[:, :-1] = np.minimum(now[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(now - slope, axis=1) + slope
    best = cost.argmin(axis=1)
    return cost[np.arange(len(cost)), best], best + n


def matches(index: Index, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
    """(text, item, distance, end): each item within its edits in each text, at its best
    place; ``end`` is the place in the text after its last character."""
    out: dict[tuple[int, int], tuple[int, int]] = {}
    group: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    held = 0
    reach = max([part.reach for part in index.parts], default=2 * SHORT)
    for row, text in enumerate(texts):
        if not text:
            continue
        points, at = normalized(text)
        for start in range(0, len(points), SLICE):  # slices of a very long text overlap by an occurrence
            part = slice(start, start + SLICE + 2 * reach)
            group.append((row, start, points[part], at[part]))
            held += len(group[-1][2])
            if held >= SLICE:
                _verify(index, group, out)
                group, held = [], 0
    _verify(index, group, out)
    return [(row, item, d, end) for (row, item), (d, end) in sorted(out.items())]


def _verify(index: Index, group: list, out: dict) -> None:
    if group:
        for part in index.parts:
            _verify_bands(part, group, out)
        if index.words:
            _find_words(index.words, group, out)


def _find_words(words: dict[int, dict[bytes, int]], group: list, out: dict) -> None:
    """The shortest items, where they stand between word borders."""
    for row, start, points, at in group:
        space = points == 32
        # a slice may begin within a word, which the slice before it has whole
        begins = np.flatnonzero(np.concatenate([[start == 0], space[:-1]]) & ~space)
        for size, known in words.items():
            ends = begins + size
            some = begins[(ends == len(points)) | ((ends < len(points)) & space[np.minimum(ends, len(points) - 1)])]
            wanted = np.array([np.frombuffer(k, points.dtype) for k in known])
            some = some[np.isin(points[some], wanted[:, 0])]
            for k in range(1, size):
                some = some[np.isin(points[some + k], wanted[:, k])]
            for a in some.tolist():
                item = known.get(points[a:a + size].tobytes())
                if item is not None:
                    found = (0, int(at[a + size - 1]) + 1)
                    out[row, item] = min(out.get((row, item), found), found)


def _verify_bands(index: Grams, group: list, out: dict) -> None:
    sizes = np.array([len(p) for _, _, p, _ in group])
    firsts = np.cumsum(sizes) - sizes
    doc, item, band = candidate_bands(index, np.concatenate([p for _, _, p, _ in group]),
                                      np.repeat(np.arange(len(group)), sizes))
    for i in np.unique(item):
        own, pattern = np.flatnonzero(item == i), index.items[i]
        step, k = int(index.step[i]), int(index.edits[i])
        width = 2 * step + 2 * k + 1
        for some in np.array_split(own, -(-len(own) // 256)):
            windows = np.zeros((len(some), len(pattern) + width - 1), dtype=np.uint32)
            lows = np.empty(len(some), np.int64)
            for w, c in enumerate(some):
                points = group[doc[c]][2]
                # diagonals count from the group's first character
                lows[w] = low = int(band[c]) * step - int(firsts[doc[c]]) - k
                a, b = max(low, 0), min(low + windows.shape[1], len(points))
                if b > a:
                    windows[w, a - low:b - low] = points[a:b]
            distance, end = banded_distances(pattern, windows)
            for w in np.flatnonzero(distance <= k):
                row, _, points, at = group[doc[some[w]]]
                last = min(max(int(lows[w] + end[w]) - 1, 0), len(points) - 1)
                found, key = (int(distance[w]), int(at[last]) + 1), (row, int(index.own[i]))
                out[key] = min(out.get(key, found), found)


def _folded_items(benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    prepare(benchmark.sparkSession)

    @F.pandas_udf("string")
    def folded(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: normalized(t)[0].tobytes().decode("utf-32-le"))

    return benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_id).alias("item_id"), folded(item_text).alias("folded"))


def distinct_items(benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``folded`` (normalised text), ``item_id`` (the least of its rows' ids) and ``n_items`` of each
    distinct normalised text; texts without letters and digits are left out."""
    rows = _folded_items(benchmark, item_id, item_text)
    return rows.where("folded <> ''").groupBy("folded").agg(F.min("item_id").alias("item_id"), F.count(F.lit(1)).alias("n_items"))


def item_members(benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id`` and ``member_id``: for each item that ``contaminated`` names, the benchmark's rows
    with the same normalised text."""
    rows = _folded_items(benchmark, item_id, item_text).withColumnRenamed("item_id", "member_id")
    return rows.join(distinct_items(benchmark, item_id, item_text).select("folded", "item_id"), "folded").select("item_id", "member_id")


def contaminated(docs: DataFrame, benchmark: DataFrame, error: float = ERROR, id_col: str = "doc_id",
                 text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id``, ``item_id``, ``n_items``, ``distance``, ``item_chars`` and ``end`` of each document and
    distinct item text that occurs in it with edits of at most ``error`` times its characters.

    Texts are compared in lower case, runs of characters other than letters and
    digits counting as one space. An item of fewer than eight characters is found
    only as it is, from word border to word border; one without letters and
    digits, or null, matches nothing. Null and empty texts hold no item. Repeated
    rows each give their own rows; of items with the same normalised text one row
    has the least id (null if none has one) and their number, ``item_members`` lists
    the others. The benchmark is taken in blocks of about four million
    characters, each with one pass over the documents. Whole texts are searched,
    very long ones in overlapping slices. An empty table gives no rows. Other
    columns are ignored.
    """
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    item_type = benchmark.schema[item_id].dataType
    schema = T.StructType([kept.schema["doc_id"], T.StructField("item_id", item_type), T.StructField("n_items", T.LongType()),
                           T.StructField("distance", T.IntegerType()), T.StructField("item_chars", T.IntegerType()),
                           T.StructField("end", T.LongType())])

    def search(index):
        def run(batches):
            known = index.value
            for b in batches:
                rows = matches(known, b.column("text").to_pylist())
                row, item, d, end = zip(*rows, strict=True) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array([known.ids[i] for i in item], to_arrow_type(item_type)),
                     pa.array([known.counts[i] for i in item], pa.int64()), pa.array(d, pa.int32()),
                     pa.array([len(known.items[i]) for i in item], pa.int32()), pa.array(end, pa.int64())],
                    ["doc_id", "item_id", "n_items", "distance", "item_chars", "end"])

        return kept.mapInArrow(run, schema)

    return _over_blocks(docs, benchmark, error, item_id, item_text, search)


def _over_blocks(docs: DataFrame, benchmark: DataFrame, error: float, item_id: str, item_text: str, search) -> DataFrame:
    """The rows of ``search(broadcast index)`` over all blocks of the benchmark's distinct texts. With
    more than one block, each pass stores its rows before the next index is built, so
    that the driver and each worker hold one block at a time."""
    spark = prepare(docs.sparkSession)
    items = distinct_items(benchmark, item_id, item_text)
    items = stored(items, "items")
    chars = items.agg(F.sum(F.char_length("folded"))).first()[0] or 0
    blocks, found = -(-chars // BLOCK_CHARS) or 1, []
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("folded"), F.lit(blocks)) == block).select("item_id", "folded", "n_items")
        index = spark.sparkContext.broadcast(build_index([tuple(r) for r in part.collect()], error))
        if blocks == 1:
            return search(index)
        found.append(stored(search(index), "hits"))
        index.unpersist()
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, error: float = ERROR, text_col: str = "text",
                         item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, unchanged, that hold no benchmark item (see ``contaminated``)."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)
    chars = benchmark.agg(F.sum(F.char_length(item_text))).first()[0] or 0
    if chars <= BLOCK_CHARS:  # one block at most: rows are judged where they are read
        def clean(index):
            def run(batches):
                for b in batches:
                    hit = {row for row, *_ in matches(index.value, b.column(at).to_pylist())}
                    yield b.filter(pa.array([row not in hit for row in range(b.num_rows)], pa.bool_()))

            return docs.mapInArrow(run, docs.schema)

        return _over_blocks(docs, benchmark, error, item_id, item_text, clean)
    rows = stored(docs.select(F.monotonically_increasing_id().alias("n"), F.struct(*[docs[c] for c in docs.columns]).alias("row")), "numbered")
    texts = rows.select("n", F.col("row").getField(text_col).alias("text"))

    def hits(index):
        def run(batches):
            for b in batches:
                hit = sorted({row for row, *_ in matches(index.value, b.column("text").to_pylist())})
                yield pa.RecordBatch.from_arrays([b.column("n").take(pa.array(hit, pa.int64()))], ["n"])

        return texts.mapInArrow(run, "n long")

    held = _over_blocks(docs, benchmark, error, item_id, item_text, hits)
    return rows.join(held, "n", "left_anti").select("row.*")
