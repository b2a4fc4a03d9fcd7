"""Repeated consecutive events: a sorted streaming state machine per entity.

Events are sorted by slot and streamed; the state is the run's anchor and the last event.  An event joins the run if it follows within
the tolerances of slot and time and repeats the anchor; otherwise the run is emitted and a new one begins.

The anchor is the event before (it moves along the run), or the run's first event.  A moving anchor needs no more than one event of context,
so entities are cut into blocks of slots, each with the last event of the block before, and runs that cross a
block border are joined afterwards from their ends only.  A fixed anchor depends on where its run began, so there an
entity is one stream, of which only the anchor is held.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reelspark.functions.arrow_vectors import doubles, ints, matrix
from reelspark.operators.ordering import spread

NONE = -(2**62)


def collapse_runs(
    df: DataFrame,
    entity: str,
    slot: str,
    stamp: str,
    vector: str,
    target: str,
    similarity: float = 0.985,
    dim: int = 64,
    block: int = 2048,
    most_slots: int = 1,
    most_time: float | None = None,
    anchor: str = "previous",
) -> DataFrame:
    """One row per run: entity, first_slot, last_slot, n_slots (the events in it), duration (last minus first ``target``).

    An event repeats the anchor (``'previous'``: the event before it, ``'first'``: the run's first one) if both have a non-NULL ``stamp`` and
    the stamps are equal or both vectors are usable with cosine >= ``similarity``.  It must follow the event before it within ``most_slots``
    slots and, if given, within ``most_time`` of ``target``.  Rows of one (entity, slot) count once.  Rows with a
    NULL slot or a NULL or NaN stamp are in no run and end one.  A NULL entity is an entity of its own.
    """
    s = F.col(slot).cast("bigint")
    slim = df.select(
        F.coalesce(F.col(entity).cast("bigint"), F.lit(NONE)).alias("ent"), s.alias("slot"), F.col(stamp).cast("double").alias("stamp"),
        F.col(target).cast("double").alias("tt"), F.col(vector).cast("array<float>").alias("vec"),
    ).where(F.col("slot").isNotNull() & F.col("stamp").isNotNull() & ~F.isnan("stamp"))
    if anchor not in ("previous", "first"):
        raise ValueError(anchor)
    if anchor == "first":
        block = 1 << 62
    if not 1 <= most_slots < block:
        raise ValueError("most_slots")
    own = F.floor(F.col("slot") / block).cast("bigint") if anchor == "previous" else F.lit(0).cast("bigint")
    border = F.pmod(F.col("slot"), F.lit(block)) >= block - most_slots if anchor == "previous" else F.lit(False)
    wide = slim.withColumn("block", F.explode(F.when(border, F.array(own, own + 1)).otherwise(F.array(own))))
    cut = spread(wide, "ent", "block").sortWithinPartitions("ent", "block", "slot", "tt")
    cut = cut.select("ent", "block", "slot", "stamp", "tt", "vec")

    def machine(batches):
        import numpy as np
        import pyarrow as pa

        state = None  # ent, block, slot, stamp, vector, usable, time of the last event
        held = (np.nan, np.zeros(dim), False)  # stamp, vector, usable of a fixed anchor
        run = None  # ent, block, first slot, cont, first tt, last slot, last tt, events of the open run
        names = ["ent", "block", "first_slot", "last_slot", "cont", "first_tt", "last_tt", "n"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.float64(), pa.int64()]

        def closed(run):
            return rows([[v] for v in (run[0], run[1], run[2], run[5], run[3], run[4], run[6], run[7])])

        def rows(cols):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            ent, blk, sl = (ints(batch.column(i)) for i in range(3))
            st, tt = doubles(batch.column(3)), doubles(batch.column(4))
            x, ok = matrix(batch.column(5), dim)
            x = x.astype(np.float64)
            x /= np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None]
            lead = state if state is not None else (NONE, NONE, NONE, np.nan, np.zeros(dim), False, np.nan)
            pe, pb, ps = (np.r_[lead[i], v[:-1]] for i, v in ((0, ent), (1, blk), (2, sl)))
            keep = ~((pe == ent) & (pb == blk) & (ps == sl))
            if not keep.any():
                continue
            ent, blk, sl, st, tt, x, ok = ent[keep], blk[keep], sl[keep], st[keep], tt[keep], x[keep], ok[keep]
            pe, pb, ps, pt = (np.r_[lead[i], v[:-1]] for i, v in ((0, ent), (1, blk), (2, sl), (3, st)))
            po, px = np.r_[lead[5], ok[:-1]], np.vstack([lead[4][None], x[:-1]])
            near = ok & po & ((x * px).sum(1) >= similarity)
            pq = np.r_[lead[6], tt[:-1]]
            follows = (pe == ent) & (pb == blk) & (sl <= ps + most_slots)
            if most_time is not None:
                follows &= tt - pq <= most_time + 1e-9
            if anchor == "first":
                rep = follows.copy()
                for i in range(len(sl)):  # the anchor stays while events repeat it
                    if rep[i] and not (held[0] == st[i] or (held[2] and ok[i] and held[1] @ x[i] >= similarity)):
                        rep[i] = False
                    if not rep[i]:
                        held = st[i], x[i], ok[i]
            else:
                rep = follows & ((st == pt) | near)
            halo = sl < blk * block if anchor == "previous" else np.zeros(len(sl), bool)
            state = ent[-1], blk[-1], sl[-1], st[-1], x[-1], ok[-1], tt[-1]
            # a run begins at every core event that repeats nothing, or that repeats the block's context event
            begin = ~halo & (~rep | ((ps < blk * block) if anchor == "previous" else False))
            count = np.r_[0, np.cumsum(~halo)]
            cont = begin & rep
            at = np.flatnonzero(begin)
            done = []
            if run is not None:
                upto = at[0] if len(at) else len(sl)
                inner = np.flatnonzero(~halo[:upto])
                if len(inner):
                    run = (*run[:5], sl[inner[-1]], tt[inner[-1]], run[7] + len(inner))
                if len(at):
                    done.append(closed(run))
            if len(at):
                last = np.r_[at[1:], len(sl)] - 1
                while True:  # a context event of the next block is not part of the run before it
                    back = halo[last] & (last > at)
                    if not back.any():
                        break
                    last = last - back
                head, tail = slice(0, len(at) - 1), -1
                if len(at) > 1:
                    a, z = at[head], last[head]
                    done.append(rows([ent[a], blk[a], sl[a], sl[z], cont[a], tt[a], tt[z], count[z + 1] - count[a]]))
                a, z = at[tail], last[tail]
                run = (ent[a], blk[a], sl[a], bool(cont[a]), tt[a], sl[z], tt[z], count[z + 1] - count[a])
            yield from done
        if run is not None:
            yield closed(run)

    parts = cut.mapInArrow(
        machine, "ent bigint, block bigint, first_slot bigint, last_slot bigint, cont boolean, first_tt double, last_tt double, n bigint"
    )
    # only runs that touch a border can go on; per entity they are at most two a block
    touches = F.col("cont") | (F.pmod(F.col("last_slot"), F.lit(block)) >= block - most_slots)
    w = Window.partitionBy("ent").orderBy("first_slot").rowsBetween(Window.unboundedPreceding, 0)
    key = F.when(touches, F.lit(1)).otherwise(F.lit(0))
    parts = parts.withColumn("edge", key)
    joined = (
        parts.where("edge = 1")
        .withColumn("grp", F.sum(F.when(F.col("cont"), 0).otherwise(1)).over(w))
        .groupBy("ent", "grp")
        .agg(F.min("first_slot").alias("first_slot"), F.max("last_slot").alias("last_slot"), F.min("first_tt").alias("first_tt"), F.max("last_tt").alias("last_tt"), F.sum("n").alias("n"))
        .drop("grp")
    )
    whole = parts.where("edge = 0").select("ent", "first_slot", "last_slot", "first_tt", "last_tt", "n").unionByName(joined)
    return whole.select(
        F.when(F.col("ent") != NONE, F.col("ent")).alias(entity), "first_slot", "last_slot",
        F.col("n").alias("n_slots"), (F.col("last_tt") - F.col("first_tt")).alias("duration"),
    )
