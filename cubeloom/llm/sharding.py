"""Sharding by vector bin packing.

Items are groups of equal texts with a vector (bytes, tokens, rows).  An item
goes where the dot product of its vector with the residual capacity is highest.

Packing runs on levels.  Items are dealt by hash to partitions; each packs its
own stream, largest first, into some local bins for each shard, keeping nothing
but the bins.  While there are more local bins than the driver takes, bins are
dealt to partitions and packed again; the driver then packs what is left into
shards the same way, and moves and swaps bins between shards while that brings
bytes, tokens and rows closer together.  A group with a large share of all rows
is cut into pieces first, so no task and no bin has to take it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Rows of one partition (of small tables fewer, so that PARTITIONS share the work), and local bins for each shard.
MOST_ROWS, LEAST_ROWS, PARTITIONS, LOCAL = 200_000, 1_500, 1_024, 8
#: Local bins that the driver packs; more are packed again by tasks of so many.
DRIVER_BINS = 65_536
#: A group is cut if it holds more than one of PARTS parts of all rows or bytes, or more rows than PIECE_ROWS.
PARTS, PIECE_ROWS = 64, 100_000
#: What a deviation counts in bytes, tokens and rows while shards are levelled, and bins of a shard that one step compares.
WEIGHTS, COMPARED = np.array([30.0, 1.0, 1.0]), 256
#: A step of levelling counts if it lowers the deviations of its two shards by this share of them, and by this much at least, so that steps end.
STEP_SHARE, STEP_LEAST = 0.01, 1e-10


class Bins:
    """Loads of bins over (bytes, tokens, rows), as shares of one bin's capacity."""

    def __init__(self, n: int, totals: np.ndarray):
        self.residual = np.ones((n, 3))
        self.scale = np.array([n / t if t else 0.0 for t in totals])

    def place(self, vector: tuple) -> int:
        """The bin with the highest dot product of vector and residual; the first of ties."""
        v = np.asarray(vector) * self.scale
        at = int((self.residual @ v).argmax())
        self.residual[at] -= v
        return at


def _level(vectors: np.ndarray, shard: np.ndarray, shards: int) -> np.ndarray:
    """Moves and swaps of packed bins between two shards while that clearly lowers the weighted squares of all deviations from the mean."""
    mean = vectors.sum(axis=0) / shards
    scale = np.where(mean > 0, 1 / np.maximum(mean, 1e-9), 0.0)
    v = vectors * scale
    shard = shard.copy()
    load = np.stack([np.bincount(shard, v[:, k], shards) for k in range(3)], axis=1)
    cost = lambda x: ((x - 1) ** 2 * WEIGHTS).sum(axis=-1)
    stuck: set[tuple[int, int]] = set()
    turn = 0
    while len(stuck) < shards * (shards - 1) // 2:
        one_by_one = cost(load)
        a, b = min(({(a, b) for b in range(shards) for a in range(b)} - stuck), key=lambda p: (-one_by_one[p[0]] - one_by_one[p[1]], p))
        # rotate through the bins, so that each is compared in some step
        one, two = (np.roll(np.flatnonzero(shard == s), -turn * COMPARED)[:COMPARED] for s in (a, b))
        turn += 1
        none = np.zeros((1, 3))
        gain = np.concatenate((v[one], none))[:, None] - np.concatenate((v[two], none))[None]
        total = cost(load[a] - gain) + cost(load[b] + gain)
        i, j = np.unravel_index(int(total.argmin()), total.shape)
        before = cost(load[a]) + cost(load[b])
        if before - total[i, j] < max(STEP_SHARE * before, STEP_LEAST):
            stuck.add((a, b))
            continue
        load[a] -= gain[i, j]
        load[b] += gain[i, j]
        if i < len(one):
            shard[one[i]] = b
        if j < len(two):
            shard[two[j]] = a
        stuck = {p for p in stuck if not {a, b} & set(p)}
    return shard


def _pack_again(local: DataFrame, bins: int, totals: np.ndarray, level: int, n: int) -> DataFrame:
    """Local bins (part, bin, b, t, n) packed into fewer: part, bin, up_part, up_bin, base, b, t, n."""
    parts = -(-n // DRIVER_BINS)
    share = totals / parts

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["b", "part", "bin"], ascending=[False, True, True], kind="stable")
        held = Bins(bins, share)
        at = np.array([held.place(v) for v in frame[["b", "t", "n"]].to_numpy(float)], np.int64)
        out = frame[["part", "bin", "up_part", "b", "t", "n"]].assign(up_bin=at)
        return out.assign(base=out.groupby("up_bin")["n"].cumsum() - out["n"])

    dealt = local.withColumn("up_part", F.pmod(F.xxhash64("part", "bin", F.lit(level)), F.lit(parts)).cast("int"))
    return dealt.groupBy("up_part").applyInPandas(pack, "part int, bin int, up_part int, b long, t long, n long, up_bin int, base long")


def pack_into_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row; the law is ``bytes``.

    Size: UTF-8 bytes of the text (null: none) plus 1.  Equal texts form a
    group that stays together unless it is cut for its size; null texts are
    one group and empty texts another.  Slots are gapless from 0 in each shard,
    in order of partition, size and doc_id.  Repeated rows are placed each (with
    one text they are one group); extra columns are ignored; an empty table
    gives none; ties go to the first bin.
    """
    spark = docs.sparkSession
    scratch = C.Scratch(spark)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.xxhash64("text")).alias("group"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
    )
    rows = scratch.save(rows)
    n, *totals = rows.agg(F.count("*"), F.sum("size"), F.sum("tokens")).first()
    if not n:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "tokens")
    total = totals[0]
    totals = np.array([*totals, n], float)
    partitions = -(-n // min(MOST_ROWS, max(LEAST_ROWS, n // PARTITIONS)))
    # at most 2 * PARTS + n / PIECE_ROWS groups are that large, which bounds what is broadcast
    limit = max(min(n / PARTS, PIECE_ROWS), 1.0), max(total / PARTS, 1.0)
    hot = rows.groupBy("group", "size").agg(F.count("*").alias("k")).where((F.col("k") > limit[0]) | (F.col("k") * F.col("size") > limit[1]))
    hot = hot.where("k > 1").select("group", "size", F.ceil(F.greatest(F.col("k") / limit[0], F.col("k") * F.col("size") / limit[1])).alias("cuts"))
    rows = rows.join(F.broadcast(hot), ["group", "size"], "left")
    piece = F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("cuts")), F.lit(0))
    rows = rows.select("*", piece.alias("piece")).withColumn("part", F.pmod(F.xxhash64("group", "size", "piece"), F.lit(partitions)).cast("int"))
    dealt = rows.select("part", "size", "group", "piece", "doc_id", "tokens", "text_crc32").repartition(partitions, "part")
    bins, share = LOCAL * shards, totals / partitions
    names = ["part", "bin", "place", "doc_id", "size", "text_crc32", "tokens"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[Bins, np.ndarray]] = {}

        def packed(table: pa.Table) -> pa.RecordBatch:
            part, size, group, piece, tokens = (table.column(k).to_numpy() for k in ("part", "size", "group", "piece", "tokens"))
            cuts = np.concatenate(([0], 1 + np.flatnonzero((part[1:] != part[:-1]) | (size[1:] != size[:-1]) | (group[1:] != group[:-1]) | (piece[1:] != piece[:-1])), [len(part)]))
            count = np.diff(cuts)
            vectors = np.stack([np.add.reduceat(size, cuts[:-1]), np.add.reduceat(tokens, cuts[:-1]), count], axis=1).astype(float)
            at, place = np.empty(len(count), np.int64), np.empty(len(count), np.int64)
            for k, (p, v, c) in enumerate(zip(part[cuts[:-1]].tolist(), vectors, count.tolist(), strict=True)):
                if p not in held:
                    held.clear()  # parts come one after another
                    held[p] = Bins(bins, share), np.zeros(bins, np.int64)
                room, filled = held[p]
                at[k] = room.place(v)
                place[k] = filled[at[k]]
                filled[at[k]] += c
            inside = np.arange(len(part)) - np.repeat(cuts[:-1], count)
            cols = [pa.array(part), pa.array(np.repeat(at, count).astype(np.int32)), pa.array(np.repeat(place, count) + inside), *[table.column(k).combine_chunks() for k in ("doc_id", "size", "text_crc32", "tokens")]]
            return pa.RecordBatch.from_arrays(cols, names=names)

        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if not table.num_rows:
                continue
            # the last group may go on in the next batch
            keys = [table.column(k).to_numpy() for k in ("part", "size", "group", "piece")]
            other = np.flatnonzero(np.any([k != k[-1] for k in keys], axis=0))
            cut = int(other[-1]) + 1 if len(other) else 0
            rest = table.slice(cut)
            if cut:
                yield packed(table.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield packed(rest)

    packed = dealt.sortWithinPartitions("part", F.col("size").desc(), "group", "piece", "doc_id").mapInArrow(pack, "part int, bin int, place long, doc_id long, size long, text_crc32 long, tokens long")
    packed = scratch.save(packed)
    local = scratch.save(packed.groupBy("part", "bin").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("n")))
    # every level has DRIVER_BINS / bins times fewer bins; its plan tells where each went
    ups, level = [], 0
    while (left := local.count()) > DRIVER_BINS:
        up = scratch.save(_pack_again(local, bins, totals, level, left))
        ups.append(up.select("part", "bin", "up_part", "up_bin", "base"))
        local = scratch.save(up.groupBy(F.col("up_part").alias("part"), F.col("up_bin").alias("bin")).agg(*[F.sum(k).alias(k) for k in "btn"]))
        level += 1
    items = sorted((((r["part"], r["bin"]), (r["b"], r["t"], r["n"])) for r in local.collect()), key=lambda x: (-x[1][0], x[0]))
    whole = Bins(shards, totals)
    vectors = np.array([v for _, v in items], float)
    into = _level(vectors, np.array([whole.place(v) for v in vectors], np.int64), shards)
    base, plan = [0] * shards, []
    for (key, v), shard in sorted(zip(items, into.tolist(), strict=True)):
        plan.append((*key, shard, base[shard]))
        base[shard] += v[2]
    # DRIVER_BINS rows at most
    out = F.broadcast(spark.createDataFrame(plan, "part int, bin int, shard int, base long"))
    for up in reversed(ups):
        above = out.select(F.col("part").alias("up_part"), F.col("bin").alias("up_bin"), "shard", F.col("base").alias("above"))
        out = up.join(above, ["up_part", "up_bin"]).select("part", "bin", "shard", (F.col("base") + F.col("above")).alias("base"))
    return packed.join(out, ["part", "bin"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "tokens"
    )
