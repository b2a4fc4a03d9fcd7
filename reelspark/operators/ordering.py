"""Global positions inside a key without sorting the whole key in one task.

``row_number() over (partition by key order by x)`` puts a hot key into a single task.  Here each key is cut
into buckets of the ordering value, every (key, bucket) is ranked on its own, and the ranks are shifted by
the sizes of the earlier buckets: a key that holds a third of all rows is ranked by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_positions(df: DataFrame, key: str, order: list[str], bucket: Column, name: str = "pos", before: tuple[str, ...] = ()) -> DataFrame:
    """Add the 0-based rank ``name`` of each row within ``key`` by ``order``, and the key's last rank ``last_<name>``.

    For the columns ``before`` it adds the value of the row before as ``before_<column>``, NULL at the start of a bucket: for statistics.

    ``bucket`` must be a BIGINT expression that never decreases along ``order``.  A NULL key is a key of its own.
    """
    d = df.withColumn("_b", bucket)
    sizes = d.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # one row per bucket, so this window is thousands of times smaller than the data
    starts = sizes.select(
        F.col(key).alias("_k"), F.col("_b").alias("_kb"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"),
        (F.sum("_n").over(Window.partitionBy(key)) - 1).alias(f"last_{name}"),
    )
    inside = F.row_number().over(Window.partitionBy(key, "_b").orderBy(*order))
    ranked = d.withColumn("_r", inside)
    for c in before:
        ranked = ranked.withColumn(f"before_{c}", F.lag(c).over(Window.partitionBy(key, "_b").orderBy(*order)))
    return ranked.join(starts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_kb"))).withColumn(
        name, (F.col("_start") + F.col("_r") - 1).cast("bigint")
    ).drop("_b", "_k", "_kb", "_start", "_r")


def with_halo(df: DataFrame, pos: str, chunk: int, halo: int) -> DataFrame:
    """Send each row to its chunk of ``chunk`` positions and, as context, to the chunks within ``halo`` positions.

    ``df`` comes from :func:`with_positions`.  Adds ``chunk`` and ``core`` (true in the row's own chunk).
    """
    own = F.floor(F.col(pos) / F.lit(chunk)).cast("bigint")
    first = F.greatest(F.lit(0), F.floor((F.col(pos) - halo) / F.lit(chunk)).cast("bigint"))
    last = F.floor(F.least(F.col(pos) + halo, F.col(f"last_{pos}")) / F.lit(chunk)).cast("bigint")
    return (
        df.withColumn("_own", own)
        .withColumn("chunk", F.explode(F.sequence(first, last)))
        .withColumn("core", F.col("chunk") == F.col("_own"))
        .drop("_own")
    )


CHUNK = 4096


def neighbourhoods(df: DataFrame, order: list[str], halo: int, key: str = "video_id", chunk: int = CHUNK) -> tuple[DataFrame, object]:
    """Rows in chunks of positions with ``halo`` rows of context on both sides, and the window that runs through a chunk.

    Adds ``pos``, ``last_pos``, ``chunk`` and ``core``; keep ``core`` rows after use.  ``order[0]`` must be an integer column.
    """
    placed = with_positions(df, key, order, F.floor(F.col(order[0]) / chunk).cast("bigint"))
    return with_halo(placed, "pos", chunk, halo), Window.partitionBy(key, "chunk").orderBy("pos")


def carried(chunks: DataFrame, values: dict[str, Column], key: str = "video_id") -> DataFrame:
    """(key, chunk, before_<name>, after_<name>): the greatest value of all earlier and the least one of all later chunks.

    One row per chunk goes through a window of the key: thousands of times fewer than rows.
    """
    own = chunks.where("core").groupBy(key, "chunk").agg(
        *[f(v).alias(f"{p}_{n}") for n, v in values.items() for p, f in (("_hi", F.max), ("_lo", F.min))]
    )
    w = Window.partitionBy(key).orderBy("chunk")
    # looking ahead is looking back in falling order
    back, ahead = (x.rowsBetween(Window.unboundedPreceding, -1) for x in (w, Window.partitionBy(key).orderBy(F.desc("chunk"))))
    return own.select(
        key, "chunk", *[F.max(f"_hi_{n}").over(back).alias(f"before_{n}") for n in values], *[F.min(f"_lo_{n}").over(ahead).alias(f"after_{n}") for n in values]
    )


def tasks(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys) -> DataFrame:
    """Partition by ``keys`` into as many tasks as the session's shuffles have, for Python to work on.

    The number is given so that small partitions are not put together: Python's time goes by rows, not by bytes.  The hash keeps
    the planner from taking an earlier partitioning by the same keys, of a small table that few tasks hold, for as good.
    """
    return df.repartition(tasks(df.sparkSession), F.xxhash64(*keys))


def by_chunk(df: DataFrame, keys: list[str], order: list[str], rows_hint: int | None = None) -> DataFrame:
    """Co-locate and sort the chunks so that a partition can be streamed chunk by chunk."""
    return spread(df, *keys).sortWithinPartitions(*keys, *order)


def stream_groups(batches, keys: list[str], rows: int = 65536):
    """From sorted pandas batches yield frames that hold only complete groups, of about ``rows`` rows.

    A partition is never gathered: at most ``rows`` rows and one group (a bounded chunk) are held.
    """
    import pandas as pd

    held, n = [], 0
    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        n += len(pdf)
        if n < rows:
            continue
        whole = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
        last = whole[keys].iloc[-1]
        same = pd.Series(True, index=whole.index)
        for k in keys:
            same &= (whole[k] == last[k]) | (whole[k].isna() & pd.isna(last[k]))
        cut = int(same.values.argmax())
        if cut:
            yield whole.iloc[:cut].reset_index(drop=True)
            held, n = [whole.iloc[cut:]], len(whole) - cut
        else:
            held, n = [whole], len(whole)
    if held:
        yield pd.concat(held, ignore_index=True)


def group_bounds(pdf, keys: list[str]):
    """Start positions of the groups of a sorted frame, with the end appended."""
    import numpy as np

    n = len(pdf)
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        v = pdf[k]
        prev = v.shift(1)
        new |= ~((v == prev) | (v.isna() & prev.isna())).to_numpy(dtype=bool)
    new[:1] = True
    return np.append(np.flatnonzero(new), n)
