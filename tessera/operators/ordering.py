"""Sequential ids and positions without a single-partition window.

``assign_ids`` numbers rows in a total order the way ``zipWithIndex`` does:
range-partition by the order, sort inside each partition, count rows per
partition (one small row per partition), turn the counts into offsets and add
each row's index inside its partition. A key that holds a large share of the
rows is spread over many range partitions instead of landing in one task.

Both passes must see the same partition layout. Spark seeds the range
sampler with the RDD id, so two separately planned exchanges can draw
different bounds; the sorted, range-partitioned rows are therefore written
once with a reliable ``checkpoint()`` below the shared checkpoint folder
(which also cuts the lineage, so a lost executor re-reads them instead of
recomputing the input).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..session import materialize


def _materialize(df: DataFrame) -> DataFrame:
    """Write the partitioned rows once (reliable checkpoint in the shared folder)."""
    return materialize(df)


def assign_ids(df: DataFrame, order_cols: list, start: int = 1, id_col: str = "id",
               num_partitions: int | None = None) -> DataFrame:
    """Add ``id_col`` = ``start`` + rank of the row in ``order_cols`` order.

    ``order_cols`` must order rows uniquely (add a tie-breaker) for ids to be
    stable across runs and task retries.
    """
    # without an explicit count AQE may merge small neighbouring ranges; the
    # partition id is read after that, so ranges stay contiguous and ordered
    ranged = (df.repartitionByRange(num_partitions, *order_cols) if num_partitions
              else df.repartitionByRange(*order_cols)).sortWithinPartitions(*order_cols)
    # monotonically_increasing_id = partition id << 33 | index inside the partition
    tagged = _materialize(ranged.withColumn("_pid", F.spark_partition_id())
                          .withColumn("_local", F.monotonically_increasing_id()
                                      - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: a global window over it is tiny by construction
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    return (tagged.join(F.broadcast(offsets), "_pid")
            .withColumn(id_col, (F.col("_off") + F.col("_local") + F.lit(start)).cast("bigint"))
            .drop("_pid", "_local", "_off"))


def position_in_group(df: DataFrame, group_cols: list[str], order_cols: list, pos_col: str = "pos") -> DataFrame:
    """0-based position of each row inside its group in ``order_cols`` order.

    Global ids over (group, order) from :func:`assign_ids` minus each group's
    first id; the group-first table is a partial aggregation (one row per
    group) joined back, so no task ever holds a whole group. All in the JVM.
    """
    g = assign_ids(df, [*group_cols, *order_cols], start=0, id_col="_gid")
    first = g.groupBy(*group_cols).agg(F.min("_gid").alias("_gid0"))
    return g.join(first, group_cols).withColumn(pos_col, F.col("_gid") - F.col("_gid0")).drop("_gid", "_gid0")


def runs(df: DataFrame, group_cols: list[str], order_cols: list, label_col: str, run_col: str = "run",
         singleton=None) -> DataFrame:
    """Gaps and islands: 0-based index of the maximal run of equal ``label_col``
    each row belongs to inside its group, in ``order_cols`` order. Rows where
    the boolean column ``singleton`` is true form runs of their own."""
    lab = F.coalesce(F.col(label_col).cast("string"), F.lit("\u0000"))
    if singleton is not None:
        # a label no neighbour can share: the row's own (unique) order key
        own = F.to_json(F.struct(*[F.col(c) if isinstance(c, str) else c for c in order_cols]))
        lab = F.when(singleton, F.concat(F.lit("\u0001"), own)).otherwise(lab)
    out = segmented_scan(df.withColumn("_runlab", lab), group_cols, order_cols, label_col="_runlab",
                         run_col=run_col)
    return out.drop("_runlab")


def _local_scan(state: dict, keys: np.ndarray, labs: np.ndarray):
    """Per-batch part of the segmented scan; ``state`` carries the previous
    row's key/label and the open segment's counters across batches."""
    n = len(keys)
    prev_k = np.empty(n, dtype=object)
    prev_l = np.empty(n, dtype=object)
    prev_k[0], prev_l[0] = state["key"], state["lab"]
    prev_k[1:], prev_l[1:] = keys[:-1], labs[:-1]
    newkey = keys != prev_k
    if state["key"] is None:
        newkey[0] = True
    newrun = newkey | (labs != prev_l)
    idx = np.arange(n)
    start = np.maximum.accumulate(np.where(newkey, idx, -1))
    cum = np.cumsum(newrun)
    cont = start < 0                              # segment opened in an earlier batch
    s0 = np.maximum(start, 0)
    pos = np.where(cont, state["rows"] + idx, idx - s0)
    run = np.where(cont, state["runs"] - 1 + cum, cum - cum[s0])
    seg = state["segs"] + np.cumsum(newkey) - 1
    seg_lab0 = np.where(cont, state["lab0"], labs[s0])
    state.update(key=keys[-1], lab=labs[-1], rows=int(pos[-1]) + 1, runs=int(run[-1]) + 1,
                 segs=int(seg[-1]) + 1, lab0=seg_lab0[-1])
    return pos, run, seg, seg_lab0


def _fresh_state():
    return {"key": None, "lab": None, "rows": 0, "runs": 0, "segs": 0, "lab0": None}


SUMMARY_SCHEMA = ("_pid int, n long, single boolean, k1 string, l1_first string, l1_last string, r1 long, "
                  "u1 long, k2 string, l2_first string, l2_last string, r2 long, u2 long")


def segmented_scan(df: DataFrame, group_cols: list[str], order_cols: list, label_col: str | None = None,
                   pos_col: str | None = None, run_col: str | None = None,
                   num_partitions: int | None = None) -> DataFrame:
    """Position of each row in its group and index of its label run, without a
    per-group window.

    Rows are range-partitioned and sorted by (group, order), so a group holding
    a large share of the rows covers several partitions. A first pass
    summarises each partition (its first and last group segment: rows, runs,
    edge labels); a window over that summary (at most two rows per partition,
    partitioned by group) gives each partition the row and run counts carried
    in from earlier partitions; a second pass, joined with the broadcast
    carries, emits the final numbers. The range-partitioned rows are
    materialised once (see the module note), so both passes read the same
    layout. ``order_cols`` must order rows uniquely inside a group.
    """
    key = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in group_cols])
    lab = F.coalesce(F.col(label_col).cast("string"), F.lit("\u0000")) if label_col else F.lit("")
    keys = [*group_cols, *order_cols]
    tagged = df.withColumn("_key", key).withColumn("_lab", lab)
    ranged = tagged.repartitionByRange(num_partitions, *keys) if num_partitions else tagged.repartitionByRange(*keys)
    base = _materialize(ranged.sortWithinPartitions(*keys).withColumn("_pid", F.spark_partition_id()))

    def summarize(batches):
        st, pid, first, out = _fresh_state(), None, None, None
        total = 0
        for pdf in batches:
            if pdf.empty:
                continue
            pid = int(pdf["_pid"].iloc[0])
            k = pdf["_key"].to_numpy(dtype=object)
            lb = pdf["_lab"].to_numpy(dtype=object)
            pos, run, seg, lab0 = _local_scan(st, k, lb)
            total += len(k)
            m = seg == 0
            if m.any():
                last0 = np.flatnonzero(m)[-1]
                first = (k[0] if first is None else first[0], lb[0] if first is None else first[1],
                         lb[last0], int(pos[last0]) + 1, int(run[last0]) + 1)
            out = (k[-1], lab0[-1], lb[-1], int(pos[-1]) + 1, int(run[-1]) + 1)
        if pid is None:
            return
        single = st["segs"] == 1
        yield pd.DataFrame([{"_pid": pid, "n": total, "single": single, "k1": first[0], "l1_first": first[1],
                             "l1_last": first[2], "r1": first[3], "u1": first[4],
                             "k2": out[0], "l2_first": out[1], "l2_last": out[2], "r2": out[3], "u2": out[4]}])

    summary = base.select("_pid", "_key", "_lab").mapInPandas(summarize, SUMMARY_SCHEMA)
    entries = summary.select("_pid", F.lit(0).alias("_e"), F.col("k1").alias("k"), F.col("r1").alias("r"),
                             F.col("u1").alias("u"), F.col("l1_first").alias("lf"), F.col("l1_last").alias("ll")) \
        .unionByName(summary.filter(~F.col("single")).select(
            "_pid", F.lit(1).alias("_e"), F.col("k2").alias("k"), F.col("r2").alias("r"), F.col("u2").alias("u"),
            F.col("l2_first").alias("lf"), F.col("l2_last").alias("ll")))
    w = Window.partitionBy("k").orderBy("_pid", "_e")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cont = (F.lag("ll").over(w) == F.col("lf")).cast("long")
    carries = (entries.withColumn("_cont", F.coalesce(cont, F.lit(0)))
               .withColumn("_roff", F.coalesce(F.sum("r").over(before), F.lit(0)))
               .withColumn("_uoff", F.coalesce(F.sum("u").over(before), F.lit(0)) - F.sum("_cont").over(upto))
               .filter(F.col("_e") == 0).select("_pid", "_roff", "_uoff"))
    joined = base.join(F.broadcast(carries), "_pid")
    out_fields = [f for f in df.schema.fields]
    extra = [T.StructField(c, T.LongType()) for c in (pos_col, run_col) if c]
    schema = T.StructType([*out_fields, *extra])
    names = [f.name for f in out_fields]

    def finish(batches):
        st = _fresh_state()
        for pdf in batches:
            if pdf.empty:
                continue
            k = pdf["_key"].to_numpy(dtype=object)
            lb = pdf["_lab"].to_numpy(dtype=object)
            pos, run, seg, _ = _local_scan(st, k, lb)
            first = seg == 0
            res = pdf[names].copy()
            if pos_col:
                res[pos_col] = np.where(first, pos + pdf["_roff"].to_numpy(), pos).astype(np.int64)
            if run_col:
                res[run_col] = np.where(first, run + pdf["_uoff"].to_numpy(), run).astype(np.int64)
            yield res

    return joined.mapInPandas(finish, schema)
