"""Sharding by balanced label propagation.

Documents linked by an equal text should share a shard.  Every linked
document starts on a hashed shard.  In each round a join brings every document
the shards of its neighbours; those that do not stand where most of them stand
ask to move there.  As many move from one shard to another as move back, and
beyond that as many as the target has room for, so quotas hold throughout.
Rounds go on while the number of cut edges (linked pairs in different shards)
falls.

Groups then settle: each on the shard that holds most of its members, as far
as its quota lets it, the refused ones on a shard drawn by its room, until all
are settled or no shard has room.  Groups that are large against a shard (at
most 64 per shard) come after the small ones, whole where they fit, else cut
over what is left.  Unlinked documents fill every shard to its exact row
count, so counts differ by one at most.  DataFrame expressions only.

Defined cases: a null text has no bytes (size 1, crc of the empty text) and
links with nothing; empty texts are equal texts; repeated rows and ids are
documents of their own; a null id is hashed as null; a group that no shard
has room for is cut; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexicarta.llm.common import Staged

#: Rows that one ranking window should hold at most, on average.
RANK_ROWS = 50_000
#: Most rounds of propagation.
ROUNDS = 8
#: Buckets in which a shard's proposers are summed.
EDGE_BUCKETS = 1024


def _u(*columns) -> Column:
    """Uniform in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(1 << 53))


def _ranked(rows: DataFrame, keys: list[str], bucket: Column, order: list, n: int, name: str) -> DataFrame:
    """Gapless rank from 0 within ``keys``: counts per bucket give each
    bucket's offset, a window ranks inside the bucket, so no key lands in
    one task."""
    rows = rows.withColumn("__bucket", bucket)
    counts = rows.groupBy(*keys, "__bucket").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*order)
    return (rows.withColumn("__rank", F.row_number().over(inside)).join(offsets, [*keys, "__bucket"])
            .withColumn(name, F.col("__offset") + F.col("__rank") - 1).drop("__bucket", "__rank", "__offset"))


def cut_edges(counts: DataFrame) -> int:
    """Linked pairs in different shards, from ``counts(link, shard, n)``."""
    pairs = counts.groupBy("link").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
    return int(pairs.agg(F.sum((F.col("n") * F.col("n") - F.col("same")) / 2)).first()[0] or 0)


def _allowed(flow: dict[tuple[int, int], int], held: dict[int, int], goal: list[int]) -> dict[tuple[int, int], int]:
    """Moves from shard to shard: exchanges, then what the target has room for."""
    out = {(a, b): min(n, flow.get((b, a), 0)) for (a, b), n in flow.items()}
    room = {s: max(0, goal[s] - held.get(s, 0)) for s in range(len(goal))}
    for (a, b), n in sorted(flow.items()):
        more = min(n - out[a, b], room[b])
        out[a, b] += more
        room[b] -= more
    return out


def propagate(staged: Staged, state: DataFrame, goal: list[int], rounds: int = ROUNDS) -> tuple[DataFrame, list[int]]:
    """``state(row, link, shard)`` after the rounds, and the cut edges before
    each round and at the end.  Only sums per pair of shards come to the
    driver."""
    state, cuts = staged.write(state), []
    while True:
        counts = staged.write(state.groupBy("link", "shard").agg(F.count("*").alias("n")))
        cuts.append(cut_edges(counts))
        if cuts[-1] == 0 or len(cuts) > rounds or len(cuts) > 1 and cuts[-1] >= cuts[-2]:
            return state, cuts
        wish = counts.groupBy("link").agg(F.max(F.struct("n", F.xxhash64("link", "shard").alias("tie"), "shard")).alias("x"))
        movers = state.join(wish.select("link", F.col("x.shard").alias("to")), "link").where("shard <> to")
        movers = staged.write(movers)
        flow = {(r.shard, r.to): r.n for r in movers.groupBy("shard", "to").agg(F.count("*").alias("n")).collect()}
        held = {r.shard: r.n for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        allowed = _allowed(flow, held, goal)
        limit = F.create_map(*[F.lit(x) for (a, b), n in allowed.items() for x in (a * len(goal) + b, n)])
        buckets = max(8, -(-sum(flow.values()) // RANK_ROWS))
        # the members of a group stand together in the order of moves
        ranked = _ranked(movers, ["shard", "to"], F.pmod(F.xxhash64("link", F.lit(len(cuts))), F.lit(buckets)), ["link", "row"], 0, "turn")
        moved = ranked.where(F.col("turn") < limit[F.col("shard") * len(goal) + F.col("to")]).select("row", "to")
        state = staged.write(state.join(moved, "row", "left").select("row", "link", F.coalesce("to", "shard").alias("shard")))


def _propose(free: list[int], number: int) -> Column:
    """A shard with room for the group, null if none has: the one that holds
    most of its members, in later rounds one drawn by the shards' room."""
    options = []
    for s, room in enumerate(free):
        first = F.get("members", F.lit(s)) if number == 0 else F.log(_u(F.lit(number), "link", F.lit(s)) + 1e-300) / max(1, room)
        options.append(F.when(F.col("group_rows") <= room,
                              F.struct(first.cast("double").alias("pull"), F.xxhash64("link", F.lit(s)).alias("tie"), F.lit(s).alias("shard"))))
    return F.array_max(F.array(*options))["shard"]


def _settle(staged: Staged, groups: DataFrame, free: list[int]) -> DataFrame:
    """(link, shard) of the small groups that find room whole; ``free`` is
    reduced by their rows.

    In a round a shard accepts its proposers in hashed order until its room
    is used: sums per bucket (a bounded number) name the bucket at the edge,
    and only the groups of that one are summed one by one."""
    settled, number = None, 0
    while True:
        asking = (groups.withColumn("shard", _propose(free, number)).where("shard is not null")
                  .withColumn("turn", F.xxhash64(F.lit(number), "link")).withColumn("bucket", F.pmod("turn", F.lit(EDGE_BUCKETS))))
        asking = staged.write(asking)
        sums = asking.groupBy("shard", "bucket").agg(F.sum("group_rows").alias("n")).orderBy("shard", "bucket").collect()
        if not sums:
            return settled
        edge, room = [EDGE_BUCKETS] * len(free), list(free)
        for r in sums:
            if edge[r.shard] == EDGE_BUCKETS:
                if r.n <= room[r.shard]:
                    room[r.shard] -= r.n
                else:
                    edge[r.shard] = r.bucket
        of = lambda values: F.get(F.array(*[F.lit(x) for x in values]), F.col("shard"))
        running = F.sum("group_rows").over(Window.partitionBy("shard").orderBy("turn", "link"))
        last = asking.where(F.col("bucket") == of(edge)).withColumn("upto", running).where(F.col("upto") <= of(room))
        accepted = asking.where(F.col("bucket") < of(edge)).unionByName(last.drop("upto")).select("link", "shard", "group_rows")
        accepted = staged.write(accepted)
        for r in accepted.groupBy("shard").agg(F.sum("group_rows").alias("n")).collect():  # one row per shard
            free[r.shard] -= r.n
        settled = accepted if settled is None else settled.unionByName(accepted)
        if all(x == EDGE_BUCKETS for x in edge):
            return settled
        groups, number = staged.write(groups.join(accepted.select("link"), "link", "left_anti")), number + 1


def _deal(large: list, free: list[int]) -> list[tuple]:
    """(link, low, high, shard): the places of each large group's members per
    shard.  Groups that fit a shard go first, the largest ahead."""
    most, out = max(free, default=0), []
    for r in sorted(large, key=lambda r: (r.group_rows > most, -r.group_rows, r.link)):
        fits = [s for s, room in enumerate(free) if room >= r.group_rows]
        if fits:
            order = [max(fits, key=lambda s: (r.members[s], free[s], -s))]
        else:
            order = sorted(range(len(free)), key=lambda s: (-free[s], s))
        low = 0
        for s in order:
            n = min(free[s], r.group_rows - low)
            if n > 0:
                out.append((r.link, low, low + n, s))
                free[s], low = free[s] - n, low + n
    return out


def shard_documents(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, link, group_rows, shard, slot)."""
    staged = Staged(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = staged.write(docs.withColumn("__row", F.monotonically_increasing_id()).select(
        F.col("__row").alias("row"),
        F.col(id_col).cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col(text_col).isNotNull(), F.xxhash64(text, F.crc32(text.cast("binary")))).alias("link")))
    total = rows.count()
    goal = [total // shards + (s < total % shards) for s in range(shards)]
    start = F.pmod(F.xxhash64("doc_id", "link"), F.lit(shards)).cast("int")
    members = F.array(*[F.count_if(F.col("shard") == s) for s in range(shards)]).alias("members")
    groups = staged.write(rows.where("link is not null").withColumn("shard", start).groupBy("link").agg(
        F.count("*").alias("group_rows"), members).where("group_rows > 1"))
    is_large = F.col("group_rows") * 64 > total // shards
    free = list(goal)
    small = groups.where(~is_large).select("link", "group_rows")
    state, _ = propagate(staged, rows.join(small.select("link"), "link").select("row", "link", start.alias("shard")), goal)
    moved = staged.write(state.groupBy("link").agg(members).join(small, "link"))
    settled = _settle(staged, moved, free)
    pieces = _deal(groups.where(is_large).collect(), free)  # at most 64 groups a shard
    buckets = max(8, -(-total // (shards * RANK_ROWS)))
    spread = lambda salt: F.pmod(F.xxhash64(F.lit(salt), "doc_id", "link"), F.lit(buckets))
    order = [F.xxhash64("doc_id", "link"), "doc_id", "link"]
    keep = ["doc_id", "size", "text_crc32", "link", "group_rows", "shard"]
    members = _ranked(rows.join(F.broadcast(groups.where(is_large).select("link", "group_rows")), "link"), ["link"], spread(1), order, total, "place")
    plan = rows.sparkSession.createDataFrame(pieces, "link bigint, low bigint, high bigint, shard int").withColumnRenamed("link", "group")
    held = members.join(F.broadcast(plan), (F.col("link") == F.col("group")) & (F.col("place") >= F.col("low")) & (F.col("place") < F.col("high")))
    kept = held.select(*keep)
    unsettled = groups.where(~is_large)
    if settled is not None:
        kept = kept.unionByName(rows.join(settled, "link").select(*keep))
        unsettled = unsettled.join(settled.select("link"), "link", "left_anti")
    kept = staged.write(kept)
    single = (rows.join(groups.select("link"), "link", "left_anti").select("doc_id", "size", "text_crc32", "link")
              .withColumn("group_rows", F.lit(1).cast("bigint")))
    pool = single.unionByName(rows.join(unsettled, "link").select(*single.columns))
    pool = _ranked(pool.withColumn("one", F.lit(0)), ["one"], spread(2), order, total, "place")
    ends, at = [], 0
    for s in range(shards):
        at += free[s]
        ends.append(at)
    shard = reduce(lambda c, s: F.when(F.col("place") < ends[s], s).otherwise(c), reversed(range(shards)), F.lit(shards - 1))
    filled = pool.withColumn("shard", shard.cast("int")).drop("one", "place")
    everything = staged.write(kept.select(*filled.columns).unionByName(filled))
    return _ranked(everything, ["shard"], spread(3), order, total, "slot").select(
        "doc_id", "size", "text_crc32", "link", "group_rows", "shard", F.col("slot").cast("bigint").alias("slot"))
