"""Mixing sources to target weights by Sainte-Laguë apportionment.

Each word of the mix is a seat, dealt to sources by the highest quotients of target and odd numbers, then within a source to
its shards by their sizes. In a shard the documents are laid in a seeded order and cut into blocks of equal length; whole
passes and a seeded, evenly spread choice of blocks fill its quota. A small shard has small blocks, so that a source of a few words gets
its share too. Only sizes of sources and shards reach the driver.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelwise.llm.tables import word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_COPIES = 2
BLOCK_WORDS = 128  # at most
LEAST_BLOCKS = 128  # of a shard, where it has as many words
SHARD_WORDS = 65_536
MAX_SHARDS = 100_000  # for all sources together, besides one each; shards grow beyond it
BROADCAST_SOURCES = 100_000  # sent to all tasks; more are joined
SEED = 20_240_229


def targets(sizes: list[int], weights: list[float], share: float = SHARE, most: float = MOST_COPIES) -> list[float]:
    """Shares of ``share`` times all sizes by weight, none above ``most`` times its size."""
    out = [0.0] * len(sizes)
    left, open_ = share * sum(sizes), [i for i, s in enumerate(sizes) if s]
    while open_:
        unit = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if unit * weights[i] > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
    return out


def sainte_lague(votes: list[float], seats: int, caps: list[int] | None = None) -> list[int]:
    """Seats by the highest quotients ``votes / (2 * seats + 1)``; ties go to the earlier one.

    Rounding with the mean divisor comes within one seat each of the result, so only the rest is dealt
    one by one. ``caps`` bound the seats of each; seats beyond all caps are not dealt.
    """
    total = sum(votes)
    caps = caps or [seats] * len(votes)
    out = [min(c, int(seats * v / total + 0.5)) if total else 0 for v, c in zip(votes, caps, strict=True)]
    excess = sum(out) - seats
    if excess > 0:
        heap = [(v / (2 * q - 1), -i) for i, (v, q) in enumerate(zip(votes, out, strict=True)) if q]
        heapq.heapify(heap)
        for _ in range(excess):
            _, i = heapq.heappop(heap)
            out[-i] -= 1
            if out[-i]:
                heapq.heappush(heap, (votes[-i] / (2 * out[-i] - 1), i))
    else:
        heap = [(-v / (2 * q + 1), i) for i, (v, q, c) in enumerate(zip(votes, out, caps, strict=True)) if v and q < c]
        heapq.heapify(heap)
        for _ in range(-excess):
            if not heap:
                break
            _, i = heapq.heappop(heap)
            out[i] += 1
            if out[i] < caps[i]:
                heapq.heappush(heap, (-votes[i] / (2 * out[i] + 1), i))
    return out


def _taken_before(x: Column) -> Column:
    """Words taken of the first ``x`` words of a shard in its last, partial pass."""
    block, blocks, rest, turn = F.col("mix_length"), F.col("mix_blocks"), F.col("mix_rest"), F.col("mix_turn")

    def chosen(k: Column) -> Column:
        return F.floor((k + turn) * rest / blocks) - F.floor(turn * rest / blocks)

    k = F.floor(x / block)
    return block * chosen(k) + (x - k * block) * (chosen(k + 1) - chosen(k))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST_COPIES,
    block: int = BLOCK_WORDS,
    seed: int = SEED,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` of its source, and ``taken``.

    ``size`` counts the words of ``text`` (null: 0). Sources are ordered by code point with null last and
    weigh ``weights``, repeating. ``taken`` is the number of a document's words in the mix, repeats
    counted, at most ``most`` times its size; over a source it comes within half a block per shard of the target, a block being
    a word, 128 words, or a 128th of the shard. The
    result depends on rows and seed only: order and repeated runs do not change it. Repeated rows are
    documents of their own; empty tables give no rows. Existing columns of these names are replaced.
    """
    ours = ("size", "source_size", "target", "taken")
    docs = docs.drop(*ours).withColumn("size", word_count(F.col("text")))
    spark = docs.sparkSession
    found = docs.groupBy("source").agg(F.sum("size").alias("words")).collect()  # a row for each source
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["words"] for r in found]
    goal = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], share, most)
    per_shard = max(SHARD_WORDS, sum(sizes) // MAX_SHARDS + 1)
    counts = [max(1, -(-s // per_shard)) for s in sizes]

    names = T.StructType(
        [
            T.StructField("mix_source", T.StringType()),
            T.StructField("mix_index", T.IntegerType()),
            T.StructField("mix_shards", T.LongType()),
            T.StructField("source_size", T.LongType()),
            T.StructField("target", T.DoubleType()),
        ]
    )
    rows = [(r["source"], i, counts[i], sizes[i], goal[i]) for i, r in enumerate(found)]
    small = len(rows) <= BROADCAST_SOURCES
    sources = spark.createDataFrame(rows, names)
    sources = F.broadcast(sources) if small else sources
    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    dealt = (
        docs.join(sources, docs["source"].eqNullSafe(F.col("mix_source")))
        .withColumn("mix_key", key)
        .withColumn("mix_shard", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("mix_key")), F.col("mix_shards")))
    )

    shards = (
        dealt.groupBy("mix_index", "mix_shard").agg(F.sum("size").alias("words")).orderBy("mix_index", "mix_shard").collect()
    )  # at most MAX_SHARDS rows, and one for each source
    seats = sainte_lague(goal, round(sum(goal)), [most * s for s in sizes])
    by_source: dict[int, list] = {}
    for r in shards:
        by_source.setdefault(r["mix_index"], []).append(r)
    plan = []
    for i, own in by_source.items():
        given = sainte_lague([float(r["words"]) for r in own], seats[i], [most * r["words"] for r in own])
        for r, quota in zip(own, given, strict=True):
            words = r["words"]
            length = max(1, min(block, words // LEAST_BLOCKS))
            full = min(most, quota // words) if words else 0
            rest = round((quota - full * words) / length) if full < most else 0
            plan.append((i, r["mix_shard"], length, -(-words // length), full, rest))
    shard_type = "mix_index int, mix_shard long, mix_length long, mix_blocks long, mix_full long, mix_rest long"
    quota = spark.createDataFrame(plan, shard_type)
    quota = F.broadcast(quota) if small else quota

    line = Window.partitionBy("mix_index", "mix_shard").orderBy("mix_key", "doc_id", "size")
    end = F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))
    turn = F.when(
        F.col("mix_blocks") > 0, F.pmod(F.xxhash64(F.lit(seed + 2), F.col("mix_index"), F.col("mix_shard")), F.col("mix_blocks"))
    ).otherwise(0)
    last = F.col("mix_end")
    partial = F.when(
        (F.col("mix_rest") > 0) & (F.col("size") > 0), _taken_before(last) - _taken_before(last - F.col("size"))
    ).otherwise(0)
    return (
        dealt.withColumn("mix_end", end)
        .join(quota, ["mix_index", "mix_shard"])
        .withColumn("mix_turn", turn)
        .withColumn("taken", (F.col("size") * F.col("mix_full") + partial).cast("long"))
        .select(*docs.columns, "source_size", "target", "taken")
    )
