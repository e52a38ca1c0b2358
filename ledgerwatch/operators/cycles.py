"""Time-ordered fund-flow cycles A -> B -> C -> A.

Written so that no busy account, busy pair or busy ring forces all its
combinations; the cycles are counted, not listed:

1. Large transfers are reduced to distinct directed edges.
2. Closed walks of three edges are found by opening every wedge at its least busy
   node, so the work is edges^1.5 in the worst case and a hub account never
   multiplies its own edges with each other.
   Walks whose pairs never come in order, in time or near in amount are dropped before
   any transfer is read again.
3. For a first transfer a, the number of cycles is the sum over its last transfers c
   of the middle transfers between them: sum(F(c)) - G(a) * count(c), with F and G
   running counts of the middle transfers. The last transfers of a form a rectangle
   in time and amount.
4. A walk of at most ``FEW`` transfers is counted where its transfers meet: they are dealt
   once, by walk, and each first transfer looks at the last ones of its walk.
5. For a walk of more, the rectangle sums come from running sums over blocks of
   2^level consecutive last transfers, so each transfer takes part in log(n) rows.
   Every running sum is split into many buckets with the bucket totals added from a
   small second aggregate, so a ring that holds most of the rows is spread out.

No table that grows with the transfers is broadcast: stored tables compress well, and by
the size of their files Spark would send large ones through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerwatch.functions.columns import days, hours
from ledgerwatch.functions.windows import Anchor, since
from ledgerwatch.session import stage_table
from ledgerwatch.sources.fixed_values import RING_DAYS as DAYS
from ledgerwatch.sources.fixed_values import RING_HOURS as MAX_HOURS
from ledgerwatch.sources.fixed_values import RING_MIN_AMOUNT as MIN_AMOUNT
from ledgerwatch.sources.fixed_values import RING_TOLERANCE as AMOUNT_TOLERANCE

AMOUNT_BUCKETS = 10_000  # per factor e: a bucket is 0.01 % wide
FEW = 4_000  # transfers of a walk that are compared with each other: at most FEW^2 / 4 pairs of first and last

WALK = ["a1", "a2", "a3"]


def large_transfers(transactions: DataFrame, t: Anchor) -> DataFrame:
    """The transfers a cycle can be made of; equal ones are merged with their number k."""
    return (
        since(transactions, t, days(DAYS))
        .where((F.col("direction") == "DEBIT") & F.col("channel").isin("NEFT", "RTGS"))
        .where(F.col("amount_inr") >= MIN_AMOUNT)
        .groupBy(
            F.col("account_id").alias("src"), F.col("counterparty_account_id").alias("dst"),
            F.col("txn_ts").alias("ts"), F.col("amount_inr").alias("amt"),
        )
        .agg(F.count(F.lit(1)).alias("k"))
    )


def closed_walks(edges: DataFrame) -> DataFrame:
    """All (a1, a2, a3) with edges a1->a2, a2->a3, a3->a1, once per starting point.

    Nodes are ranked by out-degree. The middle node v of a wedge u -> v -> w is the
    one with the lowest rank, so v opens at most ``edges`` wedges however busy it is.
    Accounts that pay themselves fall under the same rule; ``distinct`` drops the
    walks found from more than one position because of them.
    """
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg")).select(
        F.col("src").alias("node"), F.struct("deg", "src").alias("rank")
    )
    # a node without an outgoing edge is on no closed walk: inner joins are enough
    ranked = edges.join(degree.withColumnsRenamed({"node": "src", "rank": "src_rank"}).hint("merge"), "src").join(
        degree.withColumnsRenamed({"node": "dst", "rank": "dst_rank"}).hint("merge"), "dst"
    )
    into = ranked.where("dst_rank <= src_rank").select(F.col("src").alias("u"), F.col("dst").alias("v"))
    out = ranked.where("src_rank <= dst_rank").select(F.col("src").alias("v"), F.col("dst").alias("w"))
    closing = edges.select(F.col("src").alias("w"), F.col("dst").alias("u"))
    closed = into.join(out.hint("merge"), "v").join(closing.hint("merge"), ["w", "u"], "left_semi")

    def walk(a: str, b: str, c: str) -> Column:
        return F.struct(F.col(a).alias("a1"), F.col(b).alias("a2"), F.col(c).alias("a3"))

    rotations = F.array(walk("u", "v", "w"), walk("v", "w", "u"), walk("w", "u", "v"))
    return closed.select(F.explode(rotations).alias("walk")).select("walk.*").distinct()


def possible_walks(walks: DataFrame, big: DataFrame) -> DataFrame:
    """Walks on which a cycle can exist by the earliest and latest time and the amounts of each pair.

    A pair with many transfers is opened only for walks that pass this test. ``transfers`` is the
    number of rows of ``big`` on the three pairs.
    """
    edge = big.groupBy("src", "dst").agg(
        F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.min("amt").alias("low"), F.max("amt").alias("high"), F.count(F.lit(1)).alias("n")
    )
    out = walks
    for i, (src, dst) in enumerate([("a1", "a2"), ("a2", "a3"), ("a3", "a1")], 1):
        out = out.join(edge.toDF(src, dst, *[f"{c}_{i}" for c in ("t0", "t1", "low", "high", "n")]).hint("merge"), [src, dst])
    tolerance = F.lit(AMOUNT_TOLERANCE).cast("decimal(2,1)")
    in_order = (F.col("t0_1") < F.col("t1_2")) & (F.col("t0_2") < F.col("t1_3")) & (F.col("t0_1") < F.col("t1_3"))
    in_time = F.col("t0_3") <= F.col("t1_1") + hours(MAX_HOURS)
    alike = (F.col("high_3") >= F.col("low_1") * (1 - tolerance)) & (F.col("low_3") <= F.col("high_1") * (1 + tolerance))
    return out.where(in_order & in_time & alike).select(*WALK, (F.col("n_1") + F.col("n_2") + F.col("n_3")).alias("transfers"))


def _legs(walks: DataFrame, big: DataFrame) -> DataFrame:
    """Transfers on each leg (1, 2, 3) of each walk."""
    legs = F.array(
        F.struct(F.lit(1).alias("leg"), F.col("a1").alias("src"), F.col("a2").alias("dst")),
        F.struct(F.lit(2).alias("leg"), F.col("a2").alias("src"), F.col("a3").alias("dst")),
        F.struct(F.lit(3).alias("leg"), F.col("a3").alias("src"), F.col("a1").alias("dst")),
    )
    by_leg = walks.select(*WALK, F.explode(legs).alias("l")).select(*WALK, "l.*")
    return by_leg.join(big.hint("merge"), ["src", "dst"]).select(
        *WALK, "leg", "ts", "amt", "k"
    )


def _count_in_pairs(legs: DataFrame) -> DataFrame:
    """Cycles per walk from the pairs of its first and last transfers.

    Between a and c lie F(c) - G(a) middle transfers: those before c less those up to a. At equal times
    last transfers come first and first transfers last. The window and the join use the same deal by walk.
    """
    pos = F.when(F.col("leg") == 1, 2).when(F.col("leg") == 2, 1).otherwise(0)
    in_time = Window.partitionBy(*WALK).orderBy("ts", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = legs.withColumn("pos", pos).withColumn("mid", F.sum(F.when(F.col("leg") == 2, F.col("k")).otherwise(0)).over(in_time))
    tolerance = F.lit(AMOUNT_TOLERANCE).cast("decimal(2,1)")
    cents = F.col("amt") * 100
    # the bounds of a first transfer are computed once, in whole units: a pair compares plain numbers
    first = ranked.where("leg = 1").select(
        *WALK, "ts", "amt", "k", F.col("mid").alias("g"), (F.col("ts") + hours(MAX_HOURS)).alias("until"),
        F.ceil(cents * (1 - tolerance)).cast("bigint").alias("low"), F.floor(cents * (1 + tolerance)).cast("bigint").alias("high"),
    )
    last = ranked.where("leg = 3").select(*WALK, F.col("ts").alias("ts_3"), cents.cast("bigint").alias("cents_3"), F.col("k").alias("k_3"), F.col("mid").alias("f"))
    in_reach = (F.col("ts_3") > F.col("ts")) & (F.col("ts_3") <= F.col("until")) & F.col("cents_3").between(F.col("low"), F.col("high"))
    pairs = first.join(last.hint("merge"), WALK).where(in_reach & (F.col("f") > F.col("g")))
    return pairs.groupBy(*WALK).agg(F.sum((F.col("f") - F.col("g")) * F.col("k") * F.col("k_3")).alias("cycles"), F.max("amt").alias("amt"))


def running_sums(points: DataFrame, keys: list[str], bucket: Column, order: list[str], sums: list[str]) -> DataFrame:
    """Add ``cum_<name>`` (running sum within the keys) and ``all_<name>`` (total of the keys).

    ``bucket`` has to grow with ``order``. The window runs inside one bucket; what lies
    in earlier buckets is added from the bucket totals.
    """
    split = points.withColumn("bucket", bucket)
    totals = split.groupBy(*keys, "bucket").agg(*[F.sum(c).alias(f"total_{c}") for c in sums])
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(
        *keys, "bucket",
        *[F.coalesce(F.sum(f"total_{c}").over(earlier), F.lit(0)).alias(f"base_{c}") for c in sums],
        *[F.sum(f"total_{c}").over(whole).alias(f"all_{c}") for c in sums],
    )
    inside = Window.partitionBy(*keys, "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = split.withColumns({f"in_{c}": F.sum(c).over(inside) for c in sums}).join(base.hint("merge"), [*keys, "bucket"])
    return summed.withColumns({f"cum_{c}": F.col(f"base_{c}") + F.col(f"in_{c}") for c in sums}).drop(
        "bucket", *[f"in_{c}" for c in sums], *[f"base_{c}" for c in sums]
    )


def _timeline(legs: DataFrame) -> DataFrame:
    """Transfers of a walk in time order.

    At equal times last transfers come first and first transfers last: the former see
    the middle transfers strictly before them, the latter all up to their time. A first
    transfer stands at its own time and at the end of its span.
    """

    def point(kind: str, pos: int, ts: Column, mid: Column, is_last: int) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), F.lit(pos).alias("pos"), ts.alias("at"), mid.alias("mid"),
            F.lit(is_last).cast("bigint").alias("last"),
        )

    ts, none = F.col("ts"), F.lit(0).cast("bigint")
    points = (
        F.when(F.col("leg") == 1, F.array(point("from", 2, ts, none, 0), point("to", 2, ts + hours(MAX_HOURS), none, 0)))
        .when(F.col("leg") == 2, F.array(point("mid", 1, ts, F.col("k"), 0)))
        .otherwise(F.array(point("last", 0, ts, none, 1)))
    )
    exploded = legs.select(*WALK, "ts", "amt", "k", F.explode(points).alias("p")).select(*WALK, "ts", "amt", "k", "p.*")
    minute = F.date_trunc("minute", F.col("at").cast("timestamp"))
    return running_sums(exploded, WALK, minute, ["at", "pos", "amt"], ["mid", "last"])


def _highest_bit(n: Column) -> Column:
    return F.length(F.bin(n)) - 1


def _blocks(timeline: DataFrame) -> DataFrame:
    """Last transfers in their blocks, and for each first transfer the blocks it sums over.

    ``cum_last`` ranks the last transfers of a walk. The first n of them are the blocks
    given by the bits of n; a span in time is the difference of two such prefixes, and
    a span in amount again a difference, hence the signs.
    """
    tolerance = F.lit(AMOUNT_TOLERANCE).cast("decimal(2,1)")
    kind, amt, k = F.col("kind"), F.col("amt").cast("decimal(21,3)"), F.col("k")
    none = F.lit(0).cast("bigint")

    def entry(pos: int, level: Column, block: Column, value: Column, weight: Column, inner: Column, sign: int) -> Column:
        return F.struct(
            F.lit(pos).alias("pos"), level.cast("int").alias("level"), block.cast("bigint").alias("block"),
            value.cast("decimal(21,3)").alias("value"), weight.alias("n"), inner.alias("nf"), F.lit(sign).alias("sign"),
        )

    rank = F.col("cum_last") - 1
    levels = F.sequence(F.lit(0), _highest_bit(F.col("all_last")))
    stored = F.transform(
        levels, lambda l: entry(1, l, rank / F.pow(F.lit(2), l), amt, k, k * F.col("cum_mid"), 0)
    )
    count = F.col("cum_last")
    bits = F.filter(
        F.sequence(F.lit(0), _highest_bit(count)),
        lambda l: F.floor(count / F.pow(F.lit(2), l)) % 2 == 1,
    )

    def probes(sign: int) -> Column:
        def pair(l: Column) -> Column:
            block = F.floor(count / F.pow(F.lit(2), l)) - 1
            low, high = amt * (1 - tolerance), amt * (1 + tolerance)
            return F.array(entry(0, l, block, low, none, none, -sign), entry(2, l, block, high, none, none, sign))

        return F.flatten(F.transform(bits, pair))

    # carries g also when no last transfer lies before the first one: an empty block of its own
    mark = F.array(entry(0, F.lit(-1), F.lit(0), amt, none, none, 1))
    rows = F.when(kind == "last", stored).when(kind == "from", F.concat(mark, probes(-1))).otherwise(probes(1))
    return (
        timeline.where(kind != "mid")
        .withColumn("g", F.when(kind == "from", F.col("cum_mid")))
        .select(*WALK, "ts", "amt", "k", "g", F.explode(rows).alias("b"))
        .select(*WALK, "ts", "amt", "k", "g", "b.*")
    )


def _count_in_blocks(legs: DataFrame) -> DataFrame:
    """Cycles per walk from running sums over blocks of last transfers."""
    amount_bucket = F.floor(F.log(F.col("value").cast("double")) * AMOUNT_BUCKETS)
    summed = running_sums(_blocks(_timeline(legs)), [*WALK, "level", "block"], amount_bucket, ["value", "pos"], ["n", "nf"])
    per_first = (
        summed.where("sign <> 0")
        .groupBy(*WALK, "ts", "amt", "k")
        .agg(
            F.sum(F.col("sign") * F.col("cum_n")).alias("n_last"),
            F.sum(F.col("sign") * F.col("cum_nf")).alias("f_last"),
            F.max("g").alias("g"),
        )
        .withColumn("found", F.col("f_last") - F.col("g") * F.col("n_last"))
    )
    return per_first.where("found > 0").groupBy(*WALK).agg(F.sum(F.col("found") * F.col("k")).alias("cycles"), F.max("amt").alias("amt"))


def count_cycles(walks: DataFrame, big: DataFrame, stage_dir: str | None = None, few: int = FEW) -> DataFrame:
    """Rings among the walks with their number of cycles and the largest first amount.

    ``walks`` are those of ``possible_walks``, ``big`` holds at least the transfers on them. Whether a walk
    has more than ``few`` transfers is looked up when this is called; the transfers of those are written
    then, as several branches use them.
    """
    counted = _count_in_pairs(_legs(walks.where(F.col("transfers") <= few), big))
    busy = walks.where(F.col("transfers") > few)
    if not busy.isEmpty():
        counted = counted.unionByName(_count_in_blocks(stage_table(_legs(busy, big), "legs", stage_dir)))
    return counted.withColumn("ring", F.concat_ws(">", *WALK))


def cycles(transactions: DataFrame, t: Anchor, stage_dir: str | None = None, few: int = FEW) -> DataFrame:
    """Rings of the last seven days with their number of cycles and the largest first amount.

    Large transfers and walks are written when this is called.
    """
    big = stage_table(large_transfers(transactions, t), "large-transfers", stage_dir)
    walks = stage_table(possible_walks(closed_walks(big.select("src", "dst").distinct()), big), "walks", stage_dir)
    return count_cycles(walks, big, stage_dir, few)


def round_trips(rings: DataFrame) -> DataFrame:
    """Per account: cycles it takes part in, largest amount, the rings."""
    return (
        rings.withColumn("account_id", F.explode(F.array(*WALK)))
        .groupBy("account_id")
        .agg(
            F.sum("cycles").alias("round_trip_cycles_7d"),
            F.max("amt").alias("round_trip_amt"),
            F.array_sort(F.collect_set("ring")).alias("round_trip_ring"),
        )
    )
