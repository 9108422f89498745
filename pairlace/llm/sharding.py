"""Sharding by balanced label propagation, in DataFrame operations alone.

Documents of equal text are linked. Each linked document starts in the shard that its id hashes to. In a round, each
group of links votes: its members' most frequent shard among those with room is where all of them want to go; a
shard takes in movers by an order of hashes up to its quota, the rest stay. The state is the table ``(group, shard,
count)``, so a group of any size is at most 40 rows and a round's joins are small. Members that no round could place
are dealt to the shards with room in order of their group, so they lie in few shards. Unlinked documents, which have no
neighbours, then fill each shard to its quota. The law is ``rows``: shard sizes differ by at most one.

Groups that hold a large part of all rows are not shuffled by their key, and sums before a row go by cells, so no task
sees all rows of a group or of a shard. Null text is a group of its own with no bytes, and so is empty text. A very long text
is hashed and measured where it is read. Ties go by hash, then by number. Repeated rows are documents like any other. Empty
tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairlace.llm.common import gapless_rank, meet, only, stored

SHARDS, ROUNDS, SALTS = 40, 16, 64


def _before(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _quotas(spark, total: int, shards: int) -> DataFrame:
    """``shard, quota``: one row a shard; they add up to the number of documents."""
    return spark.range(shards).select(F.col("id").cast("int").alias("shard"), (F.floor((F.col("id") + 1) * total / shards) - F.floor(F.col("id") * total / shards)).cast("long").alias("quota"))


def _sums_before(rows: DataFrame, key: str, n: str, name: str) -> DataFrame:
    """Adds the sum of ``n`` over the rows before, of those with equal ``key``, the largest first. Rows are summed by cells (of
    like size, then of the group's hash) and cells laid end to end, so no task sorts all rows of a key."""
    cell = (F.lit(64) - F.floor(F.log2(n))) * 64 + F.pmod(F.xxhash64("grp"), F.lit(64))
    each = rows.withColumn("_cell", cell.cast("int"))
    sums = each.groupBy(key, "_cell").agg(F.sum(n).alias("_s"))
    starts = sums.withColumn("_off", F.coalesce(F.sum("_s").over(_before(Window.partitionBy(key).orderBy("_cell"))), F.lit(0))).drop("_s")
    inside = F.coalesce(F.sum(n).over(_before(Window.partitionBy(key, "_cell").orderBy(F.desc(n), "grp"))), F.lit(0))
    return each.withColumn("_in", inside).join(starts, [key, "_cell"]).withColumn(name, F.col("_off") + F.col("_in")).drop("_cell", "_off", "_in")


def propagate(state: DataFrame, quotas: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``grp, shard, n``: how many members of each group lie where after the rounds. Ties go to the shard of the
    smaller hash with the group. A group is accepted by a shard while the sum of the movers before it, in order of
    hashes, is under the shard's room; the last one is taken in part."""
    for k in range(rounds):
        load = state.groupBy("shard").agg(F.sum("n").alias("load"))
        room = stored(quotas.join(load, "shard", "left").select("shard", F.greatest(F.col("quota") - F.coalesce("load", F.lit(0)), F.lit(0)).alias("room")))
        votes = state.join(room, "shard").withColumn("order", F.xxhash64("grp", "shard"))
        size = Window.partitionBy("grp")
        best = votes.withColumn("total", F.sum("n").over(size)).where("n < total")
        pick = Window.partitionBy("grp").orderBy(F.desc(F.least(F.col("n") + F.col("room"), F.col("total"))), F.desc("n"), "order")
        goal = best.withColumn("r", F.row_number().over(pick)).where("r = 1 and room > 0").select("grp", F.col("shard").alias("goal"))
        movers = state.join(goal, "grp").where("shard <> goal").select("grp", "shard", "goal", "n")
        asked = movers.groupBy("goal", "grp").agg(F.sum("n").alias("want"))
        # the movers of one shard in order: sums of hash cells first, then within a cell, so no task sorts them all
        asked = asked.withColumn("cell", F.pmod(F.xxhash64(F.lit(k), "grp"), F.lit(1024))).withColumn("h", F.xxhash64("grp"))
        cells = asked.groupBy("goal", "cell").agg(F.sum("want").alias("s"))
        cells = cells.withColumn("off", F.coalesce(F.sum("s").over(_before(Window.partitionBy("goal").orderBy("cell"))), F.lit(0))).drop("s")
        inner = _before(Window.partitionBy("goal", "cell").orderBy("h", "grp"))
        placed = asked.withColumn("in", F.coalesce(F.sum("want").over(inner), F.lit(0))).join(cells, ["goal", "cell"])
        placed = placed.join(room.withColumnRenamed("shard", "goal"), "goal")
        grant = placed.select("goal", "grp", F.greatest(F.lit(0), F.least(F.col("want"), F.col("room") - F.col("off") - F.col("in"))).alias("grant")).where("grant > 0")
        grant = stored(grant)
        if grant.isEmpty():
            break
        run = _before(Window.partitionBy("grp").orderBy(F.desc("n"), "shard"))
        leave = movers.join(grant, ["grp", "goal"]).withColumn("sofar", F.coalesce(F.sum("n").over(run), F.lit(0)))
        leave = leave.withColumn("go", F.greatest(F.lit(0), F.least(F.col("n"), F.col("grant") - F.col("sofar")))).where("go > 0")
        delta = leave.select("grp", "shard", (-F.col("go")).alias("n")).unionByName(leave.select("grp", F.col("goal").alias("shard"), F.col("go").alias("n")))
        state = stored(state.unionByName(delta).groupBy("grp", "shard").agg(F.sum("n").alias("n")).where("n > 0"))
    return state


def assign_shards(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of each row; slots run from 0 in each shard without gaps."""
    spark = docs.sparkSession
    d = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = stored(d.select("doc_id", (F.octet_length(raw) + 16).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.lit("null")).alias("grp")))
    first = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")
    sizes = rows.groupBy("grp").agg(F.count("*").alias("members"))
    linked_groups = stored(sizes.where("members > 1"))
    total = rows.count()
    quotas = stored(_quotas(spark, total, shards))
    linked = stored(meet(rows, linked_groups, "grp", "members"))
    state = stored(linked.groupBy("grp", first.alias("shard")).agg(F.count("*").alias("n")))
    state = propagate(state, quotas, rounds)

    # what exceeds a quota leaves, the smallest groups of the shard first; it and the unlinked fill what is free
    over = _sums_before(state.join(F.broadcast(quotas), "shard"), "shard", "n", "sofar")  # quotas: one row a shard
    state = over.withColumn("stay", F.greatest(F.lit(0), F.least(F.col("n"), F.col("quota") - F.col("sofar"))))
    state = stored(state.select("grp", "shard", F.col("stay").alias("n")).where("n > 0"))
    held = state.groupBy("shard").agg(F.sum("n").alias("held"))
    free = quotas.join(held, "shard", "left").select("shard", (F.col("quota") - F.coalesce("held", F.lit(0))).alias("free"))
    free = free.withColumn("lo", F.coalesce(F.sum("free").over(_before(Window.partitionBy(F.lit(0)).orderBy("shard"))), F.lit(0)))  # one row a shard
    free = stored(free.select("shard", "lo", (F.col("lo") + F.col("free")).alias("hi")).where("hi > lo"))

    # members of a group take its places in order
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    member = gapless_rank(linked.drop("members"), ["grp"], [F.col("doc_id"), F.col("size")], salt, "m")
    places = state.withColumn("lo", F.coalesce(F.sum("n").over(_before(Window.partitionBy("grp").orderBy("shard"))), F.lit(0)))
    seats = places.groupBy("grp").agg(F.collect_list(F.struct("shard", "lo", (F.col("lo") + F.col("n")).alias("hi"))).alias("seats"))  # at most one a shard
    member = meet(member, stored(linked_groups.join(seats, "grp", "left")), "grp", "members")
    seat = F.filter("seats", lambda x: (x["lo"] <= F.col("m")) & (F.col("m") < x["hi"]))
    member = member.withColumn("shard", F.get(seat, F.lit(0))["shard"]).select("doc_id", "size", "text_crc32", "grp", "members", "shard")
    single = meet(rows, linked_groups, "grp", "members", "left_anti").select("doc_id", "size", "text_crc32", "grp", F.lit(None).cast("long").alias("members"), F.lit(None).cast("int").alias("shard"))
    placed = stored(member.unionByName(single))

    # the rest in one order: linked ones by group, then the others; each takes the place of its rank
    rest = placed.where("shard is null").withColumn("kind", F.when(F.col("members").isNotNull(), 0).otherwise(1))
    rest = rest.withColumn("cell", (F.col("kind") * 256 + F.pmod(F.xxhash64("grp"), F.lit(256))) * 16 + F.pmod(F.xxhash64("doc_id"), F.lit(16)))
    rest = gapless_rank(rest.withColumn("one", F.lit(0)), ["one"], [F.col("grp"), F.col("doc_id"), F.col("size")], F.col("cell"), "r").drop("one")
    span = free.agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "shard"))).alias("spans"))  # one row, one entry a shard
    spans = span.first()["spans"] or []
    taken = F.lit(None).cast("int")
    for s in spans:
        taken = F.when((F.col("r") >= s["lo"]) & (F.col("r") < s["hi"]), F.lit(s["shard"])).otherwise(taken)
    rest = rest.withColumn("shard", taken).select("doc_id", "size", "text_crc32", "grp", "shard")
    done = stored(placed.where("shard is not null").select("doc_id", "size", "text_crc32", "grp", "shard").unionByName(rest))
    out = gapless_rank(done, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)), "slot")
    return out.select("doc_id", "size", "text_crc32", "grp", "shard", "slot")


def cut_edges(assigned: DataFrame) -> DataFrame:
    """One row: links between equal texts (each to its group's largest part), and how many lie across shards."""
    parts = assigned.groupBy("grp", "shard").agg(F.count("*").alias("n")).groupBy("grp").agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    return parts.agg(F.sum(F.col("n") - 1).alias("links"), F.sum(F.col("n") - F.col("most")).alias("cut"))
