"""Near-duplicate documents by SimHash and covering locality-sensitive hashing.

A document's 64-bit fingerprint holds, for each bit, the majority over its
hashed word shingles. Fingerprints within ``radius`` bits are linked. To find
them, each bit position gets a vector of ``radius + 1`` bits, and each nonzero
vector ``v`` of that length makes a table keyed by the bits whose vectors have an
odd product with ``v`` (Pagh, 2016). The vectors of at most ``radius`` differing
bits don't span the space, so some ``v`` is orthogonal to all of them, and the
pair agrees on that table's whole key: no link is missed.

A bucket is never expanded into pairs: its task returns a spanning forest of its
links. A bucket with many fingerprints is split by a covering of the bits that
its key leaves free, which halves them at each level.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, prepare, stored, utf8
from .components import component_roots

BITS = 64
#: Fingerprints of a bucket that one task compares; larger buckets are split.
BUCKET = 1024
#: Bytes of text taken at a time, so that a very long text needs bounded memory.
SLICE = 4 << 20


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """Fingerprint of a text: words after lower-casing A-Z, shingles with repeats."""
    digest, counts, total, carry, start = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), 0, [], 0
    while start < len(text):
        end = start + SLICE
        while end < len(text) and text[end] not in WHITE:  # no word is cut
            end += 1
        words = carry + text[start:end].lower().split()
        start = end
        if len(words) >= shingle:
            h = np.fromiter((digest(b" ".join(s), 42) for s in zip(*[words[k:] for k in range(shingle)])),
                            dtype="<u8", count=len(words) - shingle + 1)
            for k in range(0, len(h), 1 << 16):
                counts += _bits(h[k:k + (1 << 16)])
            total += len(h)
            carry = words[len(words) - shingle + 1:]
        else:
            carry = words
    if total == 0:
        if not carry:
            return 0
        return digest(b" ".join(carry), 42)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``doc_id`` and ``fp`` (the fingerprint's bits as a signed long) of every row.
    A null, empty or blank text has fingerprint zero."""
    prepare(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("text"))

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column("text")),
                              dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return source.mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int, positions: list[int]) -> list[int]:
    """Key masks over the given bit positions: any set of at most ``radius`` of the
    positions is left out whole by at least one mask."""
    size = 1 << (radius + 1)
    rng = np.random.default_rng(2016)
    # every nonzero vector about equally often, in random order over the positions
    vectors = rng.permutation(np.arange(len(positions)) % (size - 1) + 1)
    return [sum(1 << p for p, m in zip(positions, vectors) if (int(m) & v).bit_count() % 2) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spanning_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints (breadth first)."""
    a, b, rest = [], [], fps
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            now, front = front[:64], front[64:]
            near = np.bitwise_count(rest[:, None] ^ now[None, :]) <= radius
            hit = near.any(axis=1)
            a.append(now[near[hit].argmax(axis=1)])
            b.append(rest[hit])
            front, rest = np.concatenate([front, rest[hit]]), rest[~hit]
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _bucket_links(buckets: DataFrame, radius: int) -> DataFrame:
    """Links within buckets; ``fps`` holds a bucket's fingerprints."""
    def run(batches):
        for batch in batches:
            found = [spanning_links(x.values.to_numpy(zero_copy_only=False).view(np.uint64), radius)
                     for x in batch.column("fps")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([f[k] for f in found] or [np.empty(0, np.uint64)]).view(np.int64))
                 for k in (0, 1)], ["a", "b"])

    return buckets.select("fps").mapInArrow(run, "a long, b long")


def near_links(fps: DataFrame, radius: int) -> DataFrame:
    """Links between distinct fingerprints (column ``fp``) that connect all pairs within
    ``radius`` bits. Each bucket gives at most as many links as it has fingerprints."""
    # (path, free bits) of the tables of a level; the first level has one of all bits
    level = fps.select("fp", F.lit("").alias("path"))
    tables = {"": list(range(BITS))}
    links = None
    while True:
        masks = {path: covering_masks(radius, free) for path, free in tables.items()}
        if list(tables) == [""]:  # the first level; a deeper one may have a single table, too
            own = F.array(*[F.struct(F.lit(f"/{k}").alias("path"), F.lit(_signed(m)).alias("mask"))
                            for k, m in enumerate(next(iter(masks.values())))])
            keys = level.select("fp", F.lit(0).cast("long").alias("key"), F.explode(own).alias("t"))
        else:
            listed = level.sparkSession.createDataFrame(
                [(path, f"{path}/{k}", _signed(m)) for path, ms in masks.items() for k, m in enumerate(ms)],
                "path string, next string, mask long")
            keys = (level.join(F.broadcast(listed), "path")
                    .select("fp", "key", F.struct(F.col("next").alias("path"), "mask").alias("t")))
        # a key has the bits that this and all earlier levels keep
        keys = keys.select("fp", F.col("t.path").alias("path"),
                           F.col("key").bitwiseOR(F.col("fp").bitwiseAND(F.col("t.mask"))).alias("key"))
        sizes = stored(keys.groupBy("path", "key")
                       .agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi"))
                       .where("n > 1"), "buckets")
        pairs = sizes.where((F.col("n") == 2) & (F.bit_count(F.col("lo").bitwiseXOR(F.col("hi"))) <= radius)) \
            .select(F.col("lo").alias("a"), F.col("hi").alias("b"))
        free = {f"{path}/{k}": [p for p in own if not m >> p & 1] for path, own in tables.items()
                for k, m in enumerate(masks[path])}
        most = max(map(len, free.values()))
        # with few free bits, even all distinct fingerprints of a bucket are a bounded list
        limit = BUCKET if most > 16 else 1 << 16
        members = keys.join(sizes.where("n > 2").select("path", "key", "n"), ["path", "key"])
        small = (members.where(F.col("n") <= limit).groupBy("path", "key")
                 .agg(F.collect_list("fp").alias("fps")))
        found = pairs.union(_bucket_links(small, radius))
        links = found if links is None else links.union(found)
        large = sizes.where(F.col("n") > limit)
        if large.isEmpty():
            return links.distinct()
        hot = {r["path"] for r in large.select("path").distinct().collect()}
        tables = {path: own for path, own in free.items() if path in hot}
        level = stored(members.where(F.col("n") > limit).select("fp", "path", "key"), "hot")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 4, radius: int = 4) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    Fingerprints that differ in at most ``radius`` bits are linked; the component
    id is the least document id that can be reached. Null, empty and blank texts
    share fingerprint zero and are linked like any other. Rows with a null id are
    linked too, but a component is only named by an id that is not null (null if
    it has none). Repeated rows give repeated result rows. Other columns are
    ignored. An empty table gives no rows.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    texts = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = component_roots(near_links(texts, radius)).withColumnRenamed("node", "fp")
    members = texts.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = members.groupBy("root").agg(F.min("least").alias("component_id"))
    named = members.join(names, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      shingle: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs``, unchanged, less near duplicates: one row of each component stays.

    It is the row with the least id; null ids come last, and among equal ids the
    first row stays. So repeated rows leave one row.
    """
    prepare(docs.sparkSession)
    rows = stored(docs.select(F.monotonically_increasing_id().alias("n"),
                              F.struct(*[docs[c] for c in docs.columns]).alias("row")), "numbered")
    slim = rows.select("n", F.col("row").getField(id_col).alias("id"))
    groups = near_duplicates(rows.select("n", F.col("row").getField(text_col).alias("text")), "n", "text", shingle, radius)
    first = (groups.select(F.col("doc_id").alias("n"), "component_id").join(slim, "n").groupBy("component_id")
             .agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "n")).alias("first")))
    return rows.join(first.select("first.n"), "n", "left_semi").select("row.*")
