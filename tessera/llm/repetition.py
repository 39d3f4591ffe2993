"""Quality rules on repetition inside a document, from a suffix array of its words.

The suffix array is built by prefix doubling and the longest common prefixes of
neighbouring suffixes are read off the doubling's ranks. Intervals of that array
whose suffixes share a prefix, and no longer one, are found with a stack; those
whose occurrences are not all preceded by the same word are the maximal repeats
(no repeat is longer on either side). The spans of the maximal repeats of some
length are united.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, prepare, utf8

SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
#: A repeat counts from so many words; limits of the covered share and of the longest repeat.
REPEAT_WORDS, MAX_COVERED, MAX_LONGEST = 8, 0.3, 50
#: Words of the documents that are sorted together; bytes of text that are split at a time.
BATCH_WORDS, SLICE = 200_000, 4 << 20


def _groups(sorted_keys: np.ndarray) -> np.ndarray:
    """For each place, the first place of its run of equal keys."""
    first = np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])
    return np.flatnonzero(first)[np.cumsum(first) - 1]


def suffix_array(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of all documents in order, and the common prefixes of those at places
    ``k - 1`` and ``k`` (0 at both ends). ``doc`` numbers the documents, each in one run;
    suffixes of different documents share nothing."""
    n = len(ids)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    last = np.searchsorted(doc, doc, side="right")  # end of each word's document
    key = doc.astype(np.int64) * (int(ids.max()) + 1) + ids
    order = np.argsort(key, kind="stable")
    start = _groups(key[order])
    rank = np.empty(n, np.int64)
    rank[order] = start
    levels, length = [rank.astype(np.int32)], 1
    size = np.bincount(start, minlength=n)
    open_ = order[size[start] > 1]  # words whose prefix so far occurs again, by rank
    while len(open_):
        after = open_ + length
        inside = after < last[open_]
        follow = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        old = rank[open_]
        key = old * (n + 1) + follow
        by = np.argsort(key, kind="stable")
        open_, old = open_[by], old[by]
        start = _groups(key[by])
        rank[open_] = old + start - _groups(old)
        length *= 2
        levels.append(rank.astype(np.int32))
        size = np.bincount(start, minlength=len(open_))
        open_ = open_[size[start] > 1]
    suffix = np.empty(n, np.int64)
    suffix[rank] = np.arange(n)
    common = np.zeros(n + 1, np.int64)  # of the suffixes at places k - 1 and k
    at = np.flatnonzero(levels[0][suffix[:-1]] == levels[0][suffix[1:]])
    a, b, found = suffix[at], suffix[at + 1], np.zeros(len(at), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + found, b + found
        same = (x < last[a]) & (y < last[b])
        same[same] = levels[k][x[same]] == levels[k][y[same]]
        found[same] += 1 << k
    common[at + 1] = found
    return suffix, common


def longest_repeats(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest substring that starts there and occurs
    again in the same document: the longer prefix shared with a neighbour."""
    return _by_neighbour(*suffix_array(ids, doc))


def _by_neighbour(suffix: np.ndarray, common: np.ndarray) -> np.ndarray:
    out = np.empty(len(suffix), np.int64)
    out[suffix] = np.maximum(common[:-1], common[1:])
    return out


class Intervals:
    """The intervals of the suffix array whose suffixes share ``lengths`` words, at least ``least``:
    places ``first`` to ``last``, the number of the next wider interval (``parent``, -1 if none
    is long enough), and for each place k the innermost one that has k - 1 and k (``at``)."""

    def __init__(self, common: np.ndarray, least: int):
        places = np.flatnonzero(common >= least)
        lengths, first, last, parent, at, stack = [], [], [], [], [], []
        before = -1

        def close(end: int, above: int) -> int:
            """End the open intervals that are longer than ``above``; where the last of them begins."""
            start = end
            while stack and lengths[stack[-1]] > above:
                top = stack.pop()
                last[top], start = end, first[top]
                if stack and lengths[stack[-1]] > above:
                    parent[top] = stack[-1]
                else:
                    waiting.append(top)
            return start

        waiting: list[int] = []  # just ended, with the parent still to be known
        for k, value in zip(places.tolist(), common[places].tolist()):
            if k != before + 1:
                close(before, 0)
                waiting.clear()
            start = close(k - 1, value)
            if not stack or lengths[stack[-1]] < value:
                lengths.append(value)
                first.append(start)
                last.append(-1)
                parent.append(-1)
                stack.append(len(lengths) - 1)
            for top in waiting:
                parent[top] = stack[-1]
            waiting.clear()
            at.append(stack[-1])
            before = k
        close(before, 0)
        self.lengths, self.first, self.last, self.parent = (np.array(x, np.int64) for x in (lengths, first, last, parent))
        self.at = np.full(len(common), -1, np.int64)
        self.at[places] = at


def maximal_repeats(ids: np.ndarray, doc: np.ndarray, suffix: np.ndarray, common: np.ndarray,
                    least: int) -> tuple[Intervals, np.ndarray]:
    """The intervals of repeats of at least ``least`` words, and which of them are maximal: their
    occurrences are preceded by different words, or by none."""
    found = Intervals(common, least)
    before = np.full(len(ids), -1, np.int64)
    before[1:] = np.where(doc[1:] == doc[:-1], ids[:-1], -1)
    word = before[suffix]
    changes = np.concatenate([[0], np.cumsum(word[1:] != word[:-1])]) if len(word) else np.zeros(0, np.int64)
    return found, changes[found.last] > changes[found.first] if len(found.lengths) else np.zeros(0, bool)


def longest_maximal(ids: np.ndarray, doc: np.ndarray, suffix: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """For each word, the length of the longest maximal repeat of at least ``least`` words that starts there, or 0."""
    found, maximal = maximal_repeats(ids, doc, suffix, common, least)
    out = np.zeros(len(ids), np.int64)
    if not len(found.lengths):
        return out
    best = np.where(maximal, found.lengths, 0)
    for i in np.argsort(found.lengths, kind="stable").tolist():  # wider intervals, which are shorter, come first
        if not maximal[i] and found.parent[i] >= 0:
            best[i] = best[found.parent[i]]
    inner = np.where(common[:-1] >= common[1:], found.at[:-1], found.at[1:])
    out[suffix] = np.where(inner >= 0, best[inner], 0)
    return out


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n places the spans cover."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(starts + lengths, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def repeat_figures(ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows (words in repeated windows, words in longer repeats, longest repeat) of each document."""
    n, out = len(ids), np.zeros((len(sizes), 3), np.int64)
    if n == 0:
        return out
    doc = np.repeat(np.arange(len(sizes)), sizes)
    suffix, common = suffix_array(ids, doc)
    repeats, maximal = _by_neighbour(suffix, common), longest_maximal(ids, doc, suffix, common, REPEAT_WORDS)
    full = np.flatnonzero(sizes)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])[full]
    short, long = np.flatnonzero(repeats >= WINDOW), np.flatnonzero(maximal)
    for k, x in enumerate((_covered(short, np.full(len(short), WINDOW), n), _covered(long, maximal[long], n))):
        out[full, k] = np.add.reduceat(x.astype(np.int64), first)
    out[full, 2] = np.maximum.reduceat(repeats, first)
    return out


def word_ids(text: bytes, known: dict[bytes, int]) -> np.ndarray:
    """The text's words as numbers, a slice at a time."""
    parts, start = [], 0
    while start < len(text):
        end = start + SLICE
        while end < len(text) and text[end] not in WHITE:
            end += 1
        words = text[start:end].split()
        parts.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
        start = end
    return np.concatenate(parts) if parts else np.empty(0, np.int32)


def base_figures(text: bytes) -> tuple[int, int, int]:
    """word_chars, n_symbols and n_dup_lines of a text."""
    lines = [x for x in text.split(b"\n") if x.strip(WHITE)]
    return (len(text.translate(None, WHITE).decode("utf-8", "replace")),
            len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)))


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Word, symbol and repeat counts of every row's whole text.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``,
    ``n_covered`` (words in repeats of at least eight words) and ``longest_repeat``
    (words). A null or empty text has zeros. Null ids and repeated rows pass
    through; other columns are ignored. An empty table gives no rows. A very long
    text is split a slice at a time; its suffix array holds all of its words.
    """
    prepare(docs.sparkSession)
    kept = docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat"]

    def run(batches):
        for b in batches:
            rows: list[np.ndarray] = []
            known: dict[bytes, int] = {}
            group: list[tuple] = []

            def flush():
                sizes = np.array([len(w) for _, w in group], dtype=np.int64)
                found = repeat_figures(np.concatenate([w for _, w in group]), sizes)
                rows.append(np.column_stack([sizes, np.array([base for base, _ in group]), found]))
                group.clear()
                known.clear()

            held = 0
            for text in b.column("text"):
                t = text.as_py()
                group.append((base_figures(t), word_ids(t, known)))
                held += len(group[-1][1])
                if held > BATCH_WORDS:
                    flush()
                    held = 0
            if group:
                flush()
            table = np.concatenate(rows) if rows else np.empty((0, 7), np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c.astype(np.int64)) for c in table.T)],
                                             ["doc_id", *names])

    return kept.mapInArrow(run, f"doc_id {dict(kept.dtypes)['doc_id']}, " + ", ".join(f"{n} long" for n in names))


def quality_documents(docs: DataFrame) -> DataFrame:
    """The figures with ``base_failed`` and ``kept``: a document is kept if it passes the
    base rules, its repeats cover a limited share of its words and none is too long."""
    found = repetition(docs)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    fine = (F.col("n_covered") <= MAX_COVERED * F.col("n_words")) & (F.col("longest_repeat") <= MAX_LONGEST)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        failed.alias("base_failed"), (~failed & fine).alias("kept"), "n_covered", "longest_repeat")
