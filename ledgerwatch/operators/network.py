"""Fund-flow and shared-device links between accounts.

The unit of work is one row per (device, account), never a pair of transaction
rows. Totals over pairs (ring summary, network KPIs) use closed forms and list no
pair at all; a neighbourhood opens only the pairs of the account asked for. Links in
order of volume come from sorted member lists: the largest ones and the page after a
given link look at positions that can hold them. Only the full link list, whose rows are
the pairs themselves, enumerates them, block by block of a device.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ledgerwatch.operators.cycles import running_sums
from ledgerwatch.session import stage_table

FLOW = "TRANSACTION_FLOW"
SHARED_COUNTERS = ("BRANCH", "BRANCH-COUNTER")
EXTERNAL_PREFIX = "EXT-BENF-"
EDGE_COLUMNS = [
    "source_node", "source_cust_id", "source_name", "target_node", "target_cust_id", "target_name",
    "link_type", "txn_count", "total_volume_inr", "last_activity",
]
BLOCK = 500  # members of a device on one side of a join task of the full list
SMALL_ROWS, SMALL_AMOUNT = 1 << 13, 340_000_000  # below 2^35 cents: see _sides
LIST_SPLIT = 100  # per factor e of an amount: sorted lists are split where amounts differ by 1 %
LINK_ORDER = ["total_volume_inr", "source_node", "target_node", "link_type"]  # the first descending


def _owners(accounts: DataFrame, customers: DataFrame, side: str) -> DataFrame:
    return accounts.select("account_id", "customer_id").join(
        customers.select("customer_id", "full_name"), "customer_id", "left"
    ).select(
        F.col("account_id").alias(f"{side}_node"),
        F.col("customer_id").alias(f"{side}_cust_id"),
        F.col("full_name").alias(f"{side}_name"),
    )


def flow_totals(transactions: DataFrame) -> DataFrame:
    """Labelled transfers aggregated per (account, counterparty) before any join."""
    return (
        transactions.where(F.col("synth_label") != "NORMAL")
        .groupBy(F.col("account_id").alias("source_node"), F.col("counterparty_account_id").alias("target_node"))
        .agg(
            F.count(F.lit(1)).alias("txn_count"),
            F.sum("amount_inr").alias("total_volume_inr"),
            F.max("txn_ts").alias("last_activity"),
        )
    )


def flow_edges(transactions: DataFrame, accounts: DataFrame, customers: DataFrame) -> DataFrame:
    target = _owners(accounts, customers, "target")
    edges = (
        flow_totals(transactions)
        .join(_owners(accounts, customers, "source"), "source_node", "left")
        .join(target, "target_node", "left")
        .withColumn("target_cust_id", F.coalesce("target_cust_id", "target_node"))
        .withColumn("target_name", F.coalesce("target_name", "target_node"))
        .withColumn("link_type", F.lit(FLOW))
    )
    return edges.select(EDGE_COLUMNS)


def device_use(transactions: DataFrame, accounts: DataFrame, customers: DataFrame) -> DataFrame:
    """One row per (device, known account): transactions, amount and latest use."""
    known = accounts.select("account_id", "customer_id").join(customers.select("customer_id", "full_name"), "customer_id")
    used = (
        transactions.where(~F.col("device_id").isin(*SHARED_COUNTERS))
        .groupBy("device_id", "account_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("amount_inr").alias("amount"), F.max("txn_ts").alias("last_ts"))
    )
    return used.join(known, "account_id")


_MEMBER = ["account_id", "customer_id", "full_name", "n", "amount", "last_ts"]


def _links(pairs: DataFrame, *carry: str) -> DataFrame:
    """Link rows of (device_id, a, b), a and b being member structs, a the lower account; ``carry`` columns stay."""
    # sum over row pairs of (x + y)/2 = (n_b * sum_a + n_a * sum_b)/2
    volume = (F.col("b.n") * F.col("a.amount") + F.col("a.n") * F.col("b.amount")) * F.lit("0.5").cast("decimal(2,1)")
    return pairs.select(
        F.col("a.account_id").alias("source_node"), F.col("a.customer_id").alias("source_cust_id"),
        F.col("a.full_name").alias("source_name"), F.col("b.account_id").alias("target_node"),
        F.col("b.customer_id").alias("target_cust_id"), F.col("b.full_name").alias("target_name"),
        F.concat(F.lit("SHARED_DEVICE ("), "device_id", F.lit(")")).alias("link_type"),
        F.lit(1).cast("bigint").alias("txn_count"),
        volume.cast("decimal(38,3)").alias("total_volume_inr"),
        F.greatest("a.last_ts", "b.last_ts").alias("last_activity"),
        *carry,
    )


def _members(use: DataFrame, name: str) -> DataFrame:
    return use.select("device_id", F.struct(*_MEMBER).alias(name))


def _sides(use: DataFrame, text: str | None) -> DataFrame:
    """Members with all that a link takes from one of them alone, so that no pair works it out again.

    ``cents`` holds amounts that two members can multiply as bigints: half a volume then stays a whole
    number below 2^49, which a double shows as the decimal does. Other amounts stay in ``amount``.
    """
    cents = F.col("amount") * 100
    small = (F.col("n") < SMALL_ROWS) & (F.abs("amount") < SMALL_AMOUNT) & (F.floor(cents) == cents)
    return use.select(
        "device_id", F.concat(F.lit("SHARED_DEVICE ("), "device_id", F.lit(")")).alias("link"), "account_id", "customer_id", "full_name", "n", "last_ts",
        *([F.col("amount"), F.lit(None).cast("bigint").alias("cents"), F.lit(None).cast("string").alias("last")] if text is None else [
            F.when(F.coalesce(small, F.lit(False)), None).otherwise(F.col("amount")).alias("amount"),
            F.when(small, cents.cast("bigint")).alias("cents"), F.date_format("last_ts", text).alias("last"),
        ]),
    )


_SIDE = ["account_id", "customer_id", "full_name", "n", "last_ts", "amount", "cents", "last"]


def _side(name: str) -> list[Column]:
    return [F.col(c).alias(f"{name}_{c}") for c in _SIDE]


def _volume(met: DataFrame, text: str | None) -> Column:
    """Volume of the members x and y, as in ``_links``; with ``text`` a double."""
    kind = met.schema["x_amount"].dataType

    def amount(side: str) -> Column:
        return F.coalesce(f"{side}_amount", (F.col(f"{side}_cents").cast("decimal(19,0)") * F.lit("0.01").cast("decimal(2,2)")).cast(kind))

    whole = (F.col("y_n") * amount("x") + F.col("x_n") * amount("y")) * F.lit("0.5").cast("decimal(2,1)")
    if text is None:
        return whole.cast("decimal(38,3)")
    quick = (F.col("y_n") * F.col("x_cents") + F.col("x_n") * F.col("y_cents")).cast("double") / F.lit(200.0)
    return F.when(F.col("x_cents").isNotNull() & F.col("y_cents").isNotNull(), quick).otherwise(whole.cast("decimal(38,3)").cast("double"))


def _links_of_sides(met: DataFrame, text: str | None, *carry: str) -> DataFrame:
    """Link rows of members x and y in either order; the lower account is the source."""
    met = met.withColumn("total_volume_inr", _volume(met, text)).withColumn("x_first", F.col("x_account_id") < F.col("y_account_id"))

    def end(side: str, other: str, column: str) -> Column:
        return F.when(F.col("x_first"), F.col(f"{side}_{column}")).otherwise(F.col(f"{other}_{column}"))

    later = F.greatest("x_last_ts", "y_last_ts")
    if text is not None:
        later = F.when((F.col("x_last_ts") >= F.col("y_last_ts")) | F.col("y_last_ts").isNull(), F.col("x_last")).otherwise(F.col("y_last"))
    return met.select(
        end("x", "y", "account_id").alias("source_node"), end("x", "y", "customer_id").alias("source_cust_id"),
        end("x", "y", "full_name").alias("source_name"), end("y", "x", "account_id").alias("target_node"),
        end("y", "x", "customer_id").alias("target_cust_id"), end("y", "x", "full_name").alias("target_name"),
        F.col("link").alias("link_type"), F.lit(1).cast("bigint").alias("txn_count"),
        "total_volume_inr", later.alias("last_activity"), *carry,
    )


def device_edges(use: DataFrame, block: int = BLOCK, text: str | None = None) -> DataFrame:
    """The full list of shared-device links.

    The members of a device are dealt into blocks of about ``block``; every pair of blocks is a join key
    of its own, so a device with a third of all accounts is spread over as many keys as it has block
    pairs, and no key holds more than two blocks. Each member is copied once per block of its device.
    With ``text``, a timestamp format, volumes are doubles and times text, both formed per member.
    """
    sizes = use.groupBy("device_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"), F.count(F.lit(1)).alias("members")).where("members > 1")
    own = F.pmod(F.xxhash64("account_id"), F.col("blocks")).cast("int")
    dealt = _sides(use, text).join(sizes.drop("members"), "device_id").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["device_id", "low", "high"]
    left = dealt.where("own <= other").select("device_id", F.col("own").alias("low"), F.col("other").alias("high"), "link", *_side("x"))
    right = dealt.where("own >= other").select("device_id", F.col("other").alias("low"), F.col("own").alias("high"), *_side("y"))
    # inside one block both sides hold all members: a pair is met twice there
    met = left.join(right, keys).where("low < high OR x_account_id < y_account_id")
    return _links_of_sides(met, text)


def network_graph(flows: DataFrame, use: DataFrame, text: str | None = None) -> DataFrame:
    """All links; ``text`` as in ``device_edges``."""
    if text is not None:
        flows = flows.withColumns({"total_volume_inr": F.col("total_volume_inr").cast("double"), "last_activity": F.date_format("last_activity", text)})
    return flows.unionByName(device_edges(use, text=text))


def neighbourhood(flows: DataFrame, use: DataFrame, *, customer_id: str | None = None, account_id: str | None = None) -> DataFrame:
    """Links that touch one customer or one account, opening only their own pairs."""
    if (customer_id is None) == (account_id is None):
        raise ValueError("name either a customer or an account")
    if customer_id is not None:
        in_flow = (F.col("source_cust_id") == customer_id) | (F.col("target_cust_id") == customer_id)
        own = "customer_id", customer_id
    else:
        in_flow = (F.col("source_node") == account_id) | (F.col("target_node") == account_id)
        own = "account_id", account_id
    return flows.where(in_flow).unionByName(own_links(use.where(F.col(own[0]) == own[1]), use, *own))


def own_links(mine: DataFrame, use: DataFrame, column: str, value: str) -> DataFrame:
    """Device links of the members ``mine``, all those of ``use`` whose ``column`` is ``value``."""
    met = _members(mine, "m").join(_members(use, "o"), "device_id").where("m.account_id <> o.account_id")
    # a pair of two own accounts is met from both sides: keep one
    once = met.where((F.col(f"o.{column}") != value) | (F.col("m.account_id") < F.col("o.account_id")))
    lower = F.col("m.account_id") < F.col("o.account_id")
    return _links(once.select(
        "device_id", F.when(lower, F.col("m")).otherwise(F.col("o")).alias("a"), F.when(lower, F.col("o")).otherwise(F.col("m")).alias("b")
    ))


def device_totals(use: DataFrame) -> DataFrame:
    """Pairs and pair volume per device in closed form.

    With N rows and sum S over m accounts: pairs = m(m-1)/2 and
    volume = (N * S - sum(n_i * s_i)) / 2.
    """
    m, n, s = F.count(F.lit(1)), F.sum("n"), F.sum("amount")
    own = F.sum(F.col("n") * F.col("amount"))
    return (
        use.groupBy("device_id")
        .agg(m.alias("members"), ((n * s - own) * F.lit("0.5").cast("decimal(2,1)")).cast("decimal(38,3)").alias("volume"))
        .where("members > 1")
        .select("device_id", (F.expr("members * (members - 1) div 2")).alias("pairs"), "volume")
    )


def ring_summary(flows: DataFrame, use: DataFrame) -> DataFrame:
    """Links and volume per link type, without listing the device pairs."""
    flow = flows.groupBy("link_type").agg(
        F.count(F.lit(1)).alias("connected_pairs"), F.sum("total_volume_inr").cast("decimal(38,3)").alias("total_ring_volume_inr")
    )
    shared = device_totals(use).select(
        F.concat(F.lit("SHARED_DEVICE ("), "device_id", F.lit(")")).alias("link_type"),
        F.col("pairs").alias("connected_pairs"), F.col("volume").alias("total_ring_volume_inr"),
    )
    return flow.unionByName(shared)


def network_kpis(flows: DataFrame, use: DataFrame) -> DataFrame:
    """Number of links, distinct nodes over both ends, total volume."""
    rings = ring_summary(flows, use)
    shared = use.join(device_totals(use).select("device_id"), "device_id", "left_semi").select(F.col("account_id").alias("node"))
    ends = flows.select(F.explode(F.array("source_node", "target_node")).alias("node"))
    nodes = ends.unionByName(shared).distinct().agg(F.count(F.lit(1)).alias("unique_nodes"))
    totals = rings.agg(
        F.sum("connected_pairs").alias("network_links"), F.sum("total_ring_volume_inr").alias("total_exposure_inr")
    )
    return totals.withColumn("unique_nodes", nodes.scalar())


def _ordered(links: DataFrame) -> DataFrame:
    first, *rest = LINK_ORDER
    return links.orderBy(F.desc(first), *rest)


def _ranked(use: DataFrame, probes: DataFrame | None = None) -> DataFrame:
    """Members in their lists with ``pos``, and ``probes`` with the number of members before them.

    A list is the accounts of one device with the same number n of rows, largest amount first, then
    account. Positions are running sums split by amount, so a list with a third of all accounts is
    not sorted in one task.
    """
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    key = [F.col("device_id"), F.col("n").alias("list"), _cents(F.col("amount")).alias("at"), F.col("account_id").alias("name")]
    rows = use.select(*key, F.lit(1).alias("side"), one.alias("here"), F.struct(*_MEMBER).alias("m"), F.lit(None).cast("bigint").alias("partner_list"))
    if probes is not None:
        rows = rows.unionByName(probes.withColumn("here", none))
    # grows as amounts fall; amounts of nothing or less come last
    span = F.when(F.col("at") > 0, -F.floor(F.log(F.col("at").cast("double")) * LIST_SPLIT)).otherwise(F.lit(1 << 40))
    return running_sums(rows.withColumn("down", -F.col("at")), ["device_id", "list"], span, ["down", "name", "side"], ["here"])


def _cents(amount: Column) -> Column:
    return (amount * 100).cast("decimal(38,0)")


def _lists(use: DataFrame) -> DataFrame:
    """Size of each list of a device with several members."""
    sizes = use.groupBy("device_id", F.col("n").alias("list")).agg(F.count(F.lit(1)).alias("size"))
    several = sizes.groupBy("device_id").agg(F.sum("size").alias("members")).where("members > 1").select("device_id")
    return sizes.join(several, "device_id", "left_semi")


def _paired(rows: DataFrame, members: DataFrame, *carry: str) -> DataFrame:
    """Links of member ``m`` with the member at position ``at_pos`` of ``partner_list``."""
    other = members.select("device_id", F.col("list").alias("partner_list"), F.col("pos").alias("at_pos"), F.col("m").alias("o"))
    met = rows.join(other, ["device_id", "partner_list", "at_pos"])
    first = F.col("m.account_id") < F.col("o.account_id")
    pairs = met.withColumns({"a": F.when(first, F.col("m")).otherwise(F.col("o")), "b": F.when(first, F.col("o")).otherwise(F.col("m"))})
    return _links(pairs, *carry)


def largest_links(flows: DataFrame, use: DataFrame, k: int) -> DataFrame:
    """The k links with the greatest volume (ties: source, target, link type).

    A pair's volume grows with the amount of each member, so in two lists of a device the pair at
    positions (x, y) is behind all pairs (x', y') with x' <= x and y' <= y: at most k ln k positions
    per two lists can be among the k largest, and only those are looked up.
    """
    members = _ranked(use).select("device_id", "list", "m", F.col("cum_here").alias("pos")).where(F.col("pos") <= k + 1)
    lists = _lists(use).select("device_id", F.col("list").alias("partner_list"), "size")
    x = F.col("pos")
    same = F.col("list") == F.col("partner_list")
    # number of pairs that are not behind (x, y), itself included: x * y, in one list x * y - x (x + 1) / 2
    last = F.when(same, F.floor((k + x * (x + 1) / 2) / x)).otherwise(F.floor(F.lit(k) / x)).cast("bigint")
    rows = members.join(lists, "device_id").where("list <= partner_list").withColumn("from_pos", F.when(same, x + 1).otherwise(1)).withColumn("to_pos", F.least(last, "size"))
    rows = rows.where("from_pos <= to_pos").withColumn("at_pos", F.explode(F.sequence("from_pos", "to_pos")))
    return _ordered(flows.unionByName(_paired(rows, members))).limit(k)


def links_after(flows: DataFrame, use: DataFrame, after: Row | dict, size: int) -> DataFrame:
    """The next ``size`` links behind the link ``after`` (its LINK_ORDER columns), in order.

    Per member and partner list the partners behind ``after`` are the rest of the list from one
    position on, which a probe finds in the sorted list. Of these (member, list) rows only the
    ``size`` with the largest first link matter, and of the row ranked r only its first size - r + 1
    partners. So a page costs one pass over the members and size^2 / 2 lookups, whichever page it is.
    """
    key = {c: F.lit(after[c]) for c in LINK_ORDER}
    key["total_volume_inr"] = key["total_volume_inr"].cast("decimal(38,3)")
    # behind: a smaller volume, or the same and later names
    names = F.struct(*[F.col(c) for c in LINK_ORDER[1:]]) > F.struct(*[key[c].alias(c) for c in LINK_ORDER[1:]])
    volume = F.col("total_volume_inr")
    behind = (volume < key["total_volume_inr"]) | ((volume == key["total_volume_inr"]) & names)

    # each pair is looked for from one side only: from its shorter list, in one list from the earlier member
    rows = use.join(_lists(use).select("device_id", F.col("list").alias("other_list")), "device_id").where("n <= other_list")
    rest = _cents(key["total_volume_inr"] * 2) - F.col("other_list") * _cents(F.col("amount"))  # what n times the partner's amount may be
    at = F.floor(rest / F.col("n")).cast("decimal(38,0)")
    at = F.when(at * F.col("n") > rest, at - 1).when((at + 1) * F.col("n") <= rest, at + 1).otherwise(at)
    me, kind = F.col("account_id"), F.concat(F.lit("SHARED_DEVICE ("), "device_id", F.lit(")"))
    tied = at * F.col("n") == rest
    # among partners that tie with ``after``, the first name that comes behind it, and whether that name itself does
    full = (me > key["target_node"]) | ((me == key["target_node"]) & (kind > key["link_type"]))
    name = F.when(~tied, F.lit("")).when(me < key["source_node"], F.lit("\U0010ffff")).when(me == key["source_node"], key["target_node"]).otherwise(key["source_node"])
    included = F.when(me == key["source_node"], kind > key["link_type"]).otherwise(full)
    probes = rows.select(
        "device_id", F.col("other_list").alias("list"), at.alias("at"), name.alias("name"), F.when(included, 0).otherwise(2).alias("side"),
        F.struct(*_MEMBER).alias("m"), F.col("n").alias("partner_list"),
    )
    ranked = stage_table(_ranked(use, probes).select("device_id", "list", "m", "partner_list", F.col("cum_here").alias("pos"), F.col("all_here").alias("size")), "ranked-links")
    members = ranked.where("partner_list IS NULL")
    own = members.select("device_id", F.col("list").alias("partner_list"), F.col("m.account_id").alias("account_id"), F.col("pos").alias("own_pos"))
    starts = ranked.where("partner_list IS NOT NULL").withColumn("account_id", F.col("m.account_id")).join(own, ["device_id", "partner_list", "account_id"])
    first = F.when(F.col("list") == F.col("partner_list"), F.greatest(F.col("pos"), F.col("own_pos"))).otherwise(F.col("pos")) + 1
    starts = starts.select("device_id", F.col("list").alias("partner_list"), "m", first.alias("first"), "size").where("first <= size")

    carry = ["device_id", "partner_list", "m", "first", "size"]
    best = _ordered(_paired(starts.withColumn("at_pos", F.col("first")), members, *carry)).limit(size)
    by_rank = Window.orderBy(F.desc(LINK_ORDER[0]), *LINK_ORDER[1:])  # over the ``size`` rows of best
    best = best.select(*carry, F.row_number().over(by_rank).alias("r"))
    ahead = F.sequence("first", F.least("size", F.col("first") + size - F.col("r")))
    found = _paired(best.withColumn("at_pos", F.explode(ahead)), members)
    return _ordered(flows.where(behind).unionByName(found)).limit(size)


def links_page(flows: DataFrame, use: DataFrame, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of all links in order; its key, one link, comes to the driver."""
    if number == 1:
        return largest_links(flows, use, size)
    shown = (number - 1) * size
    last = largest_links(flows, use, shown).offset(shown - 1).first()
    return flows.limit(0) if last is None else links_after(flows, use, last, size)


def external_beneficiaries(transactions: DataFrame) -> DataFrame:
    return (
        transactions.where(F.col("counterparty_account_id").startswith(EXTERNAL_PREFIX))
        .groupBy("counterparty_account_id")
        .agg(
            F.count_distinct("account_id").alias("linked_accounts"),
            F.count(F.lit(1)).alias("txn_count"),
            F.sum("amount_inr").alias("total_volume_inr"),
        )
    )
