"""Row order at scale: running totals and dense row numbers over a global order, and lags."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StatError
from ..plans.blocks import added, numbers
from ..plans.staging import stage

#: Lags up to which products of shifted rows are taken one by one; more are taken by Fourier transforms.
FEW_LAGS = 16
#: Rows of a block of such products, at least.
BLOCK_ROWS = 1 << 14
#: (variable, value) cells of a range, and rows of a part that ranks are put together in.
RANGE_CELLS = 1_000_000
PART_ROWS = 500_000


def equal_neighbours(columns: list[pa.Array]) -> np.ndarray:
    """Of each row but the first, whether all of its keys are those of the row before; null and NaN are equal to themselves."""

    def same(c: pa.Array) -> pa.Array:
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        out = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(a.is_null(), b.is_null()))
        return pc.or_(out, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False)) if pa.types.is_floating(c.type) else out

    return reduce(pc.and_, map(same, columns)).to_numpy(zero_copy_only=False)


def running_total(df: DataFrame, order: list[str], amount: str, name: str, parts: int | None = None, distinct: bool = False) -> DataFrame:
    """``df`` with the running total of ``amount`` (a whole number) in the order of its (distinct) keys.

    Rows are dealt by range, sorted there, and added up as they are written: one
    shuffle. A total for each range, one row each, tells where the next one starts.
    distinct: rows with equal keys are refused; they show as neighbours, so this costs no further pass.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [f"c{i}" for i in range(len(df.columns))]
    at = df.columns.index(amount)
    keys = [df.columns.index(c) for c in order]
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order).toDF(*columns)

    def add_up(batches):
        part, before, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [pa.concat_arrays([a, b]) if a is not None else b for a, b in zip(last or [None] * len(keys), batch.select(keys).columns)]
            tied = bool(equal_neighbours(own).any())
            last = [c.slice(len(c) - 1) for c in own]
            upto = before + np.cumsum(batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64))
            before = int(upto[-1])
            yield batch.append_column("part", pa.array(np.full(batch.num_rows, part), pa.int32())).append_column("upto", pa.array(upto, pa.int64())).append_column("tied", pa.array([tied] * batch.num_rows))

    fields = [*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("upto", T.LongType()), T.StructField("tied", T.BooleanType())]
    dealt = stage(rows.mapInArrow(add_up, T.StructType(fields)), "ranges")
    sums, before, total = dealt.groupBy("part").agg(F.max("upto").alias("sum"), F.max("tied").alias("tied")).collect(), {}, 0  # a row for each range
    if distinct and any(row["tied"] for row in sums):
        raise StatError("invalid_request", f"{', '.join(order)} don't tell all rows apart.", "Rows with equal values have no order.", "Name further variables of the order.")
    for row in sorted(sums, key=lambda r: r["part"]):
        before[row["part"]] = total
        total += row["sum"] or 0
    starts = df.sparkSession.createDataFrame(list(before.items()), "part int, before long")
    return dealt.join(F.broadcast(starts), "part").select(*columns, (F.col("before") + F.col("upto")).alias("total")).toDF(*df.columns, name)


@dataclass
class Autocovariances:
    """Sums of products of rows with those before them: products[l] is that of s(t) s(t - l)'; and the first and last row."""

    n: int
    products: np.ndarray
    first: np.ndarray
    last: np.ndarray


def lagged_products(x: np.ndarray, before: np.ndarray, lags: int) -> np.ndarray:
    """Of rows with those up to ``lags`` places before them, which may lie in ``before``."""
    m, n, k = len(before), len(x), x.shape[1]
    both, out = np.vstack([before, x]), np.zeros((lags + 1, k, k))
    if lags <= FEW_LAGS:
        for lag in range(min(lags, m + n - 1) + 1):
            skip = max(0, lag - m)
            out[lag] = x[skip:].T @ both[m + skip - lag : m + n - lag]
        return out
    size = 1 << int(m + n + lags).bit_length()
    late = np.zeros_like(both)
    late[m:] = x
    a, b = np.fft.rfft(late, size, axis=0), np.conj(np.fft.rfft(both, size, axis=0))
    for i in range(k):
        out[:, i, :] = np.fft.irfft(a[:, i : i + 1] * b, size, axis=0)[: lags + 1]
    return out


def autocovariances(df: DataFrame, order: list[str], names: list[str], lags: int, parts: int | None = None) -> Autocovariances:
    """Of the columns ``names`` in the order of the keys, which must tell all rows apart.

    Rows are dealt by range and sorted there: one shuffle, and nothing is written
    of them. A range adds up the products of its own rows; with those of the
    ranges before it, only its first rows and their last ones have any, at most
    ``lags`` rows of each.
    """
    spark, k, shape = df.sparkSession, len(names), (lags + 1, len(names), len(names))
    n_keys, keep = len(order), max(1, lags)
    named = df.select(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order)), *(F.col(c).cast("double").alias(f"s{i}") for i, c in enumerate(names)))
    keys = [f"o{i}" for i in range(n_keys)]
    rows = named.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, tied, last, head, tail, held = np.zeros(shape), 0, False, None, np.zeros((0, k)), np.zeros((0, k)), []

        def take() -> None:
            nonlocal total, tail, held
            x = np.concatenate([*held, np.zeros((0, k))])
            total += lagged_products(x, tail[len(tail) - min(len(tail), lags) :], lags)
            tail, held = np.concatenate([tail, x])[-keep:], []

        for batch in batches:
            if not batch.num_rows:
                continue
            own = [pa.concat_arrays([a, b]) if a is not None else b for a, b in zip(last or [None] * n_keys, batch.columns[:n_keys])]
            tied, last = tied or bool(equal_neighbours(own).any()), [c.slice(len(c) - 1) for c in own]
            x = numbers(batch.select(list(range(n_keys, n_keys + k))))
            n, head = n + len(x), np.concatenate([head, x[: keep - len(head)]]) if len(head) < keep else head
            held.append(x)
            if sum(map(len, held)) >= max(BLOCK_ROWS, 4 * lags):
                take()
        if held:
            take()
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([n], pa.int64()), pa.array([tied]), *(pa.array([v.tobytes()], pa.binary()) for v in (total, head, tail))], ["part", "n", "tied", "sums", "head", "tail"])

    ranges = stage(rows.mapInArrow(run, "part int, n long, tied boolean, sums binary, head binary, tail binary"), "ranges")
    sizes = sorted(ranges.select("part", "n", "tied").collect())  # a row for each range
    if any(tied for *_, tied in sizes):
        raise StatError("invalid_request", f"{', '.join(order)} don't tell all rows apart.", "Rows with equal values have no order.", "Name further variables of the order.")
    if not sizes:
        return Autocovariances(0, np.zeros(shape), np.zeros(k), np.zeros(k))
    ends = np.cumsum([n for _, n, _ in sizes]).tolist()
    starts = [0, *ends[:-1]]
    first = np.frombuffer(ranges.where(F.col("part") == sizes[0][0]).select("head").first()[0]).reshape(-1, k)[0]
    last = np.frombuffer(ranges.where(F.col("part") == sizes[-1][0]).select("tail").first()[0]).reshape(-1, k)[-1]
    products = added(ranges, shape)
    if lags and len(sizes) > 1:
        # Each range's first rows meet the last ones of those that end at most ``lags`` rows before it.
        meet = [(sizes[q][0], sizes[q][0], starts[q]) for q in range(1, len(sizes))]
        for q in range(1, len(sizes)):
            p = q - 1
            while p >= 0 and starts[q] - ends[p] < lags:
                meet.append((sizes[p][0], sizes[q][0], ends[p]))
                p -= 1
        places = spark.createDataFrame(meet, "part int, into int, place long")
        edges = ranges.join(F.broadcast(places), "part").select("into", "place", (F.col("part") == F.col("into")).alias("own"), F.when(F.col("part") == F.col("into"), F.col("head")).otherwise(F.col("tail")).alias("rows"))

        def across(table: pa.Table) -> pa.Table:
            got = sorted(table.select(["own", "place", "rows"]).to_pylist(), key=lambda r: (r["own"], r["place"]))
            *ahead, x = [np.frombuffer(r["rows"]).reshape(-1, k) for r in got]
            before = np.concatenate([*ahead, np.zeros((0, k))])[-lags:]
            return pa.table({"sums": pa.array([(lagged_products(x, before, lags) - lagged_products(x, before[:0], lags)).tobytes()], pa.binary())})

        products = products + added(edges.groupBy("into").applyInArrow(across, "sums binary"), shape)
    return Autocovariances(ends[-1], products, first, last)


def ranked(df: DataFrame, names: list[str]) -> DataFrame:
    """Average ranks (ties share theirs) of all of these columns, in columns of these names; they must have no missing values.

    Cells (variable, value, row) of all variables are dealt by range once, and
    ranked where they lie: a range's totals, a row each, tell where the next one
    starts, and what a value has in several ranges. Then ranks are put together
    by row, once for all variables. A value that very many rows share is dealt to several ranges.
    """
    spark, k = df.sparkSession, len(names)
    rows = stage(df.select(F.monotonically_increasing_id().alias("id"), *(F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(names))), "rows")
    n = rows.count()
    if k == 1:
        cells = rows.select(F.lit(0).alias("v"), F.col("x0").alias("x"), "id")
    else:
        each = F.explode(F.array(*(F.struct(F.lit(i).alias("v"), F.col(f"x{i}").alias("x")) for i in range(k)))).alias("cell")
        cells = rows.select(each, "id").select("cell.v", "cell.x", "id")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * k // RANGE_CELLS))
    dealt = cells.repartitionByRange(parts, "v", "x", "id").sortWithinPartitions("v", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        v, x, row = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(3))
        x = x + 0.0  # one zero
        new = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (v[1:] != v[:-1])))
        size = np.diff(np.append(new, len(x)))
        segment = np.searchsorted(v, v[new])  # where the variable's cells begin here
        start, many = np.repeat(new - segment, size), np.repeat(size, size)
        part = np.full(len(x), TaskContext.get().partitionId(), np.int32)
        for lo in range(0, len(x), 100_000):
            cut = slice(lo, lo + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(a[cut]) for a in (part, v, x, row, start, many)], ["part", "v", "x", "id", "start", "many"])

    local = stage(dealt.mapInArrow(run, "part int, v int, x double, id long, start long, many long"), "ranks")
    totals = local.groupBy("part", "v").agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), F.min_by("many", "x").alias("lows"), F.max_by("many", "x").alias("highs")).collect()
    known = []
    for v in range(k):  # a row for each range and variable in it
        own = sorted((t for t in totals if t["v"] == v), key=lambda t: t["part"])
        runs, before = [], 0  # (value, first rank - 1, cells) of the values at the ranges' ends
        places = []
        for t in own:
            if runs and runs[-1][0] == t["low"]:
                runs[-1][2] += t["lows"]
            else:
                runs.append([t["low"], before, t["lows"]])
            low = runs[-1]
            if t["high"] != t["low"]:
                runs.append([t["high"], before + t["n"] - t["highs"], t["highs"]])
            places.append((t["part"], v, before, t["low"], low, t["high"], runs[-1]))
            before += t["n"]
        known += [(p, v, b, low, a[1] + (a[2] + 1) / 2, high, c[1] + (c[2] + 1) / 2) for p, v, b, low, a, high, c in places]
    offsets = spark.createDataFrame(known, "part int, v int, before long, low double, low_rank double, high double, high_rank double")
    rank = F.when(F.col("x") == F.col("low"), F.col("low_rank")).when(F.col("x") == F.col("high"), F.col("high_rank")).otherwise(F.col("before") + F.col("start") + (F.col("many") + 1) / 2)
    cells = local.join(F.broadcast(offsets), ["part", "v"]).select("id", "v", rank.alias("rank"))
    if k == 1:
        return cells.select(F.col("rank").alias(names[0]))
    # As many parts as the rows need, not as the session has: each row's cells meet in one, and none are added up before.
    dealt = cells.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // PART_ROWS)), "id")
    return dealt.groupBy("id").agg(*(F.max(F.when(F.col("v") == i, F.col("rank"))).alias(name) for i, name in enumerate(names))).drop("id")


def dense_index(df: DataFrame, order: list[str], name: str = "__index") -> DataFrame:
    """``df`` with row numbers from 1; an order that doesn't tell all rows apart is refused."""
    return running_total(df.withColumn("__one", F.lit(1)), order, "__one", name, distinct=True).drop("__one")


def with_lags(df: DataFrame, index: str, columns: list[str], lags: int, bucket: int = 100_000) -> DataFrame:
    """``df`` with column__1 ... column__lags, the values that many rows before.

    Rows lie in buckets of dense numbers; a bucket also gets the last rows of
    the one before, so windows stay within buckets.
    """
    size = max(bucket, 2 * lags)
    own = df.withColumn("__bucket", F.floor(F.col(index) / size)).withColumn("__own", F.lit(True))
    shared = own.where(F.col(index) % size >= size - lags).withColumn("__bucket", F.col("__bucket") + 1).withColumn("__own", F.lit(False))
    window = Window.partitionBy("__bucket").orderBy(index)
    lagged: list[Column] = [F.lag(c, k).over(window).alias(f"{c}__{k}") for c in columns for k in range(1, lags + 1)]
    return own.unionByName(shared).select("*", *lagged).where("__own").drop("__bucket", "__own")
