"""Periodic runs of words by online dyadic square catching.

A run is a stretch of words with a period ``q`` (words ``q`` apart are equal) that
no neighbouring word extends. A text is read from left to right. Whenever an
aligned block of ``b`` words (a power of two) is complete, it becomes a catcher: it
waits for its copy ``p`` words later, for the ``p`` of its level. Each appended
word ends one stretch of ``b`` words per level, whose name (a hash doubled from
the level below) is compared with the names of the one or two catchers that wait
for it. A copy is checked word by word and extended to the left at once; to the
right, the comparison of each open lag goes on with every appended word. Once
the equal words are as many as the lag, the stretch is a square; the squares of a
lag that overlap merge into one run.

The levels are chosen so that nothing is missed: the words of a run that equal
those ``p`` further are at least ``m(p) = max(least_length - p, (least_periods - 1) p)``
in a row, and any ``2 b - 1`` words in a row hold an aligned block of ``b``.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, utf8

LEAST_LENGTH, LEAST_PERIODS = 24, 3
#: Bytes of text whose results are returned together.
PART = 4 << 20
#: Odd multipliers of the names (from the golden ratio and the square root of two).
MULTIPLY, ADD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x6A09E667F3BCC909)

RUN_TYPE = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    x = a * MULTIPLY
    x += b
    x ^= x >> np.uint64(31)
    x *= ADD
    return x


class _Level:
    """The catchers of one block size: the names of the latest stretches of ``size`` words,
    ``names[0]`` that of the stretch at ``first``. Lags from ``lo`` to ``hi`` are caught."""

    def __init__(self, size: int, lo: int, hi: int):
        self.size, self.lo, self.hi = size, lo, hi
        self.first, self.names = 0, np.empty(0, np.uint64)

    @property
    def done(self) -> int:
        return self.first + len(self.names)

    def forget(self, start: int) -> None:
        if start - self.first > 0:
            self.names = self.names[start - self.first:].copy()
            self.first = start


class SquareCatchers:
    """Runs of a sequence of integers that is appended piece by piece (of any length).

    Runs have at least ``least_length`` words and ``least_periods`` times their
    smallest period. The state grows with the words held; an append of ``c`` words
    to ``n`` costs about ``c`` steps on each of ``log n`` levels.
    """

    def __init__(self, least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS):
        if least_periods < 2:
            raise ValueError("a run has at least two periods")
        self.least_length, self.least_periods = least_length, least_periods
        stretch = min(max(least_length - p, (least_periods - 1) * p) for p in range(1, max(2, least_length + 1)))
        self.base = 1
        while 4 * self.base - 1 <= stretch:
            self.base *= 2
        self.words, self.n = np.empty(1024, np.int64), 0
        self.levels = [self._level(1)]
        self.open: dict[int, int] = {}  # lag: start of the equal words that reach the end
        self.found: set[tuple[int, int, int]] = set()  # start, end, period

    def _level(self, size: int) -> _Level:
        def least(b: int) -> int:
            return 1 if b <= self.base else -(-(2 * b - 1) // (self.least_periods - 1))
        return _Level(size, least(size), least(2 * size) - 1)

    def append(self, words: np.ndarray) -> None:
        old, n = self.n, self.n + len(words)
        if n > len(self.words):
            self.words = np.concatenate([self.words[:old], np.empty(max(n, 2 * old) - old, np.int64)])
        self.words[old:n] = words
        self.n = n
        self._advance(old)
        ground = self.levels[0]
        ground.names = np.concatenate([ground.names, _mix(self.words[old:n].astype(np.uint64), ADD)])
        k = 0
        while True:
            level = self.levels[k]
            if k:
                self._double(self.levels[k - 1], level)
            elif self.base == 1:
                self._catch(level, old, n)
            k += 1
            if k == len(self.levels):
                above = self._level(2 * level.size)
                # no run can have a lag of the level above yet
                if n < max(above.size, above.size > self.base and self.least_periods * above.lo):
                    break
                self.levels.append(above)
        for level, above in itertools.zip_longest(self.levels, self.levels[1:]):
            level.forget(min(n - level.size + 1 - level.hi, above.done if above else 0))

    def _double(self, below: _Level, level: _Level) -> None:
        """Names of the stretches that are complete now, and what their catchers find."""
        start, end, half = level.done, self.n - level.size + 1, level.size // 2
        if end <= start:
            return
        names = below.names[start - below.first:]
        new = _mix(names[:end - start], names[half:half + end - start])
        level.names = np.concatenate([level.names, new]) if len(level.names) else new
        if level.size >= self.base:
            self._catch(level, start, end)

    def _catch(self, level: _Level, start: int, end: int) -> None:
        size, first, names = level.size, level.first, level.names
        start = max(start, level.lo)
        if end <= start:
            return
        own = names[start - first:end - first]
        nearest = (np.arange(start, end) - level.lo) & -size
        blocks, lags = [], []
        for back in range(0, level.hi - level.lo + 1, size):
            begin = max(0, min(len(own), back + level.lo - start))  # earlier stretches have no such block
            block = nearest[begin:] - back
            hit = np.flatnonzero(names[block - first] == own[begin:]) if first <= 0 else \
                np.flatnonzero((block >= first) & (names[np.maximum(block - first, 0)] == own[begin:]))
            if len(hit):
                block = block[hit]
                lag = start + begin + hit - block
                near = lag <= level.hi
                blocks.append(block[near])
                lags.append(lag[near])
        if blocks:
            self._follow(size, level.lo, np.concatenate(blocks), np.concatenate(lags))

    def _follow(self, size: int, lo: int, block: np.ndarray, lag: np.ndarray) -> None:
        """Extend the copies that catchers have found; those within a run of a period
        that divides the lag tell nothing new."""
        known = self._smallest(itertools.chain(((s, e, p) for s, e, p in self.found if p < lo),
                                               ((s, self.n, p) for p, s in self.open.items() if p < lo)))
        if known:
            starts, ends, periods = np.array(known).T
            reach = np.maximum.accumulate(ends)
            first = np.concatenate([[True], ends[1:] > reach[:-1]])
            longest = np.maximum.accumulate(np.where(first, np.arange(len(ends)), 0))
            at = np.searchsorted(starts, block, side="right") - 1
            run = longest[np.maximum(at, 0)]
            new = (at < 0) | (ends[run] < block + lag + size) | (lag % periods[run] > 0)
            block, lag = block[new], lag[new]
        order = np.lexsort((block, lag))
        block, lag = block[order], lag[order]
        bounds = np.flatnonzero(np.diff(lag, prepend=-1, append=-1)) if len(lag) else np.empty(0, np.int64)
        for a, b in itertools.pairwise(bounds.tolist()):
            p, at = int(lag[a]), block[a:b]
            k, last = 0, self.open.get(p, self.n)
            while k < len(at) and at[k] < last:
                s = int(at[k])
                if not np.array_equal(self.words[s:s + size], self.words[s + p:s + p + size]):
                    k += 1  # the names agree by chance
                    continue
                begin, stop = self._left(s, p), self._right(s + size, p)
                self._keep(begin, stop, p)
                k = int(np.searchsorted(at, stop))

    def _keep(self, start: int, stop: int, p: int) -> None:
        """The words from ``start`` to ``stop`` equal those ``p`` further, and their neighbours don't."""
        if stop + p == self.n:
            self.open[p] = start
        elif self._long(stop + p - start, p):
            self.found.add((start, stop + p, p))

    def _long(self, length: int, p: int) -> bool:
        return length >= max(self.least_length, self.least_periods * p)

    def _advance(self, old: int) -> None:
        """Go on with the open comparisons over the appended words."""
        for p, start in list(self.open.items()):
            stop = self._right(old - p, p)
            if stop + p < self.n:
                del self.open[p]
                self._keep(start, stop, p)

    def _right(self, at: int, p: int) -> int:
        """The first place from ``at`` on whose word differs from that ``p`` further."""
        step = 64
        while at < self.n - p:
            end = min(at + step, self.n - p)
            differ = self.words[at:end] != self.words[at + p:end + p]
            if differ.any():
                return at + int(differ.argmax())
            at, step = end, 2 * step
        return at

    def _left(self, at: int, p: int) -> int:
        """The least start of words up to ``at`` that equal those ``p`` further."""
        step = 64
        while at > 0:
            begin = max(0, at - step)
            differ = self.words[begin:at] != self.words[begin + p:at + p]
            if differ.any():
                return at - int(differ[::-1].argmax())
            at, step = begin, 2 * step
        return at

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, smallest period) of the runs of the words so far, in order."""
        ends = self.found | {(s, self.n, p) for p, s in self.open.items() if self._long(self.n - s, p)}
        return [(s, e - s, p) for s, e, p in sorted(self._smallest(ends), key=lambda r: (r[0], r[2]))]

    @staticmethod
    def _smallest(stretches) -> list[tuple[int, int, int]]:
        """(start, end, smallest lag) of each stretch, in order: other lags of the same
        stretch are multiples of its period."""
        least: dict[tuple[int, int], int] = {}
        for s, e, p in stretches:
            least[s, e] = min(p, least.get((s, e), p))
        return sorted((s, e, p) for (s, e), p in least.items())


def word_ids(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter(map(known.setdefault, words, itertools.count()), np.int64, len(words))


def runs_of(words: list[bytes], least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    if len(words) < least_length:
        return []
    catchers = SquareCatchers(least_length, least_periods)
    catchers.append(word_ids(words))
    return catchers.runs()


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words joined by one space, less those of a run after its first period."""
    if runs:
        kept = np.ones(len(words), bool)
        for start, length, period in runs:
            kept[start + period:start + length] = False
        words = list(itertools.compress(words, kept.tolist()))
    return b" ".join(words)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (start, length and smallest period in words, ordered by
    start and period) and ``collapsed`` (the text less all repeats but the first
    period of each run, joined by one space) of every row's whole text.

    Words are ``[^\\x20\\x09-\\x0D]+``. A null, empty or blank text has no words, no
    runs and the collapsed text "". Null ids and repeated rows pass through, an
    empty table gives no rows, other columns are ignored whatever their names. A
    text of any length is one value: a task holds the words of one text at a time,
    and about four times the text's bytes beside it.
    """
    prepare(docs.sparkSession)
    kept = docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("text"))
    run_type = pa.list_(pa.struct([(name, pa.int64()) for name in ("start", "length", "period")]))

    def part(ids, n_words, runs, texts):
        names = ("start", "length", "period")
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(n_words, pa.int64()), pa.array([[dict(zip(names, r)) for r in rs] for rs in runs], run_type),
             pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    def run(batches):
        for b in batches:
            n_words, runs, texts, size, start = [], [], [], 0, 0
            for k, text in enumerate(b.column("text")):
                words = text.as_py().split()
                found = runs_of(words, least_length, least_periods)
                n_words.append(len(words))
                runs.append(found)
                texts.append(collapse(words, found))
                size += len(texts[-1])
                if size > PART or k + 1 == b.num_rows:
                    yield part(b.column("doc_id").slice(start, k + 1 - start), n_words, runs, texts)
                    n_words, runs, texts, size, start = [], [], [], 0, k + 1

    return kept.mapInArrow(run, f"doc_id {dict(kept.dtypes)['doc_id']}, n_words bigint, runs {RUN_TYPE}, collapsed string")


def with_planted_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``text`` of every row; every tenth text, by the crc32 ``h`` of its decimal
    id, is made periodic: with ``g = h / 10``, the words from ``g % n`` on repeat the first
    ``1 + (n - g % n) / (3 + g % 8)`` of them, and all are joined by one space. Rows
    with a null id or without words stay as they are."""
    words = F.filter(F.split(text_col, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       F.crc32(F.col(id_col).cast("string").cast("binary")).alias("h"))
    rows = rows.withColumn("g", F.expr("h div 10")).withColumn("words", F.when(F.col("h") % 10 == 0, words)) \
        .withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int")) \
        .withColumn("rest", F.col("n") - F.col("a")).withColumn("p", F.expr("cast(1 + rest div (3 + g % 8) as int)"))
    unit = F.slice("words", F.col("a") + 1, F.col("p"))
    tail = F.slice(F.flatten(F.array_repeat(unit, F.ceil(F.col("rest") / F.col("p")).cast("int"))), F.lit(1), F.col("rest"))
    tiled = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), tail), " ")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), tiled).otherwise(F.col("text")).alias("text"))


def _best(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; the first of equals."""
    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    return F.aggregate(runs, none, lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))


def run_digests(docs: DataFrame) -> DataFrame:
    """The runs of ``documents``, every tenth made periodic, as counts and digests."""
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    found = periodic_runs(with_planted_periods(docs)).withColumn("best", _best(F.col("runs")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


# In SQL: words that equal those q further for 16 words in a row, by a join of equal
# windows of 16; a run has at least 16 of them (24 - q, or 2 q). crc32 by its byte table.
RUNS_SQL = r"""
with crc as (
  select list(v order by i) as t from (
    select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                          lambda x, y: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end) as v
    from range(256) r(i))),
d as (
  select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         xor(4294967295, list_reduce(
           [4294967295] || list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint),
           lambda x, c: xor(x >> 8, t[(xor(x, c) & 255) + 1]))) as h
  from documents, crc),
e as (
  select *, len(w) as n, case when h % 10 = 0 and len(w) > 0 then (h // 10) % len(w) end as a from d),
f as (
  select rid, doc_id, n, case when a is null then w else list_transform(range(n), lambda i: case when i < a then w[i + 1]
           else w[a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) + 1] end) end as w
  from e),
words as (select rid, unnest(range(n)) as i, unnest(w) as word from f),
windows as (
  select rid, n, i, array_to_string(list_slice(w, i + 1, i + 16), ' ') as win
  from (select rid, n, w, unnest(range(n - 15)) as i from f where n >= 24)),
equal as (
  select x.rid, y.i - x.i as q, x.i from windows x join windows y on x.rid = y.rid and x.win = y.win
  where x.i < y.i and 3 * (y.i - x.i) <= x.n),
stretches as (
  select rid, q, min(i) as s, max(i) + 16 - min(i) + q as length
  from (select *, i - row_number() over (partition by rid, q order by i) as island from equal)
  group by rid, q, island),
runs as (
  select rid, s, length, q from stretches where length >= 24 and length >= 3 * q
  qualify row_number() over (partition by rid, s, length order by q) = 1),
listed as (
  select rid, count(*) as n_runs, string_agg(s || ',' || length || ',' || q || chr(10), '' order by s, q) as lines,
         arg_min({'s': s, 'length': length, 'q': q}, (-length::double / q, s, q)) as best
  from runs group by rid),
gone as (select distinct rid, unnest(range(s + q, s + length)) as i from runs),
kept as (
  select rid, string_agg(word, ' ' order by i) as text from words anti join gone using (rid, i) group by rid)
select doc_id, coalesce(n_runs, 0) as n_runs, best.s as start, best.length as length, best.q as period,
       1000 * best.length // best.q as exponent_milli, sha256(coalesce(lines, '')) as runs_sha256,
       sha256(coalesce(kept.text, '')) as collapsed_sha256
from f left join listed using (rid) left join kept using (rid)
"""
