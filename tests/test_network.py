"""Closed forms and pruning of the device network against all pairs."""

import datetime as dt
import random
import re
from collections import defaultdict
from decimal import Decimal
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import small_bank as sb
from ledgerwatch.catalog import build_registry
from ledgerwatch.catalog.registry import TS_FORMAT, present
from ledgerwatch.operators import network
from ledgerwatch.operators.adjacency import LinkTables
from ledgerwatch.plans.questions import QUESTIONS


@pytest.fixture(scope="module")
def world(spark):
    rnd = random.Random(7)
    names = [f"A{i:02d}" for i in range(25)]
    rows = []
    for _ in range(260):
        device = rnd.choice(["HOT", "HOT", "HOT", "D1", "D2", "BRANCH", f"S{rnd.randrange(9)}"])
        label = rnd.choice(["NORMAL", "NORMAL", "MULE_INFLOW"])
        rows.append(
            dict(account_id=rnd.choice(names), counterparty_account_id=rnd.choice([*names, "EXT-BENF-001", "EXT-BENF-002"]), device_id=device,
                 amount_inr=rnd.choice(["100.00", "250.50", "999.99"]), txn_ts=sb.T0 - dt.timedelta(minutes=rnd.randrange(90_000)), synth_label=label)
        )
    rows.append(dict(account_id="GHOST", device_id="HOT", txn_ts=sb.T0, amount_inr="5.00"))  # no account record
    txns = sb.transactions(spark, rows)
    owner = {a: "C03" if a == "A04" else f"C{a[1:]}" for a in names}  # one customer with two accounts
    acc = sb.accounts(spark, [dict(account_id=a, customer_id=owner[a]) for a in names])
    cust = sb.customers(spark, [dict(customer_id=f"C{a[1:]}", full_name=f"N{a[1:]}") for a in names])
    flows = network.flow_edges(txns, acc, cust).cache()
    use = network.device_use(txns, acc, cust).cache()
    return rows, flows, use


def naive_pairs(rows):
    out = defaultdict(lambda: [Decimal(0), None])
    known = [r for r in rows if r["account_id"] != "GHOST" and r["device_id"] != "BRANCH"]
    for x, y in combinations(known, 2):
        a, b = (x, y) if x["account_id"] < y["account_id"] else (y, x)
        if a["device_id"] == b["device_id"] and a["account_id"] != b["account_id"]:
            e = out[(a["account_id"], b["account_id"], f"SHARED_DEVICE ({a['device_id']})")]
            e[0] += (Decimal(a["amount_inr"]) + Decimal(b["amount_inr"])) / 2
            e[1] = max(filter(None, [e[1], a["txn_ts"], b["txn_ts"]]))
    return {k: tuple(v) for k, v in out.items()}


def keyed(df):
    return {(r.source_node, r.target_node, r.link_type): r for r in df.collect()}


def test_pairs_equal_row_level_join(world):
    rows, _, use = world
    got = {k: (r.total_volume_inr, r.last_activity) for k, r in keyed(network.device_edges(use)).items()}
    assert got == naive_pairs(rows)


def test_closed_forms_equal_the_pair_list(world):
    rows, flows, use = world
    graph = network.network_graph(flows, use).collect()
    want = defaultdict(lambda: [0, Decimal(0)])
    for r in graph:
        want[r.link_type][0] += 1
        want[r.link_type][1] += r.total_volume_inr
    got = {r.link_type: [r.connected_pairs, r.total_ring_volume_inr] for r in network.ring_summary(flows, use).collect()}
    assert got == dict(want)
    kpi = network.network_kpis(flows, use).first()
    assert kpi.network_links == len(graph)
    assert kpi.unique_nodes == len({n for r in graph for n in (r.source_node, r.target_node)})
    assert kpi.total_exposure_inr == sum(r.total_volume_inr for r in graph)


@pytest.mark.parametrize("k", [1, 3, 15])
def test_largest_links_equal_full_sort(world, k):
    _, flows, use = world
    graph = network.network_graph(flows, use).collect()
    want = sorted(graph, key=lambda r: (-r.total_volume_inr, r.source_node, r.target_node, r.link_type))[:k]
    assert [tuple(r) for r in network.largest_links(flows, use, k).collect()] == [tuple(r) for r in want]


def test_neighbourhood_equals_filtered_graph(world):
    _, flows, use = world
    graph = network.network_graph(flows, use).collect()
    near = {k for k, r in keyed(network.neighbourhood(flows, use, account_id="A07")).items()}
    assert near == {(r.source_node, r.target_node, r.link_type) for r in graph if "A07" in (r.source_node, r.target_node)}
    near = network.neighbourhood(flows, use, customer_id="C03").collect()
    assert sorted(map(str, near)) == sorted(str(r) for r in graph if "C03" in (r.source_cust_id, r.target_cust_id))
    with pytest.raises(ValueError):
        network.neighbourhood(flows, use)


@pytest.mark.parametrize("block", [1, 2, 7])
def test_blocks_of_a_device_list_every_pair_once(world, block):
    rows, _, use = world
    got = network.device_edges(use, block).collect()
    assert len(got) == len({(r.source_node, r.target_node, r.link_type) for r in got})
    assert {(r.source_node, r.target_node, r.link_type): (r.total_volume_inr, r.last_activity) for r in got} == naive_pairs(rows)


def test_shown_links_equal_the_presented_list(spark, world):
    """Doubles and text formed per member are those of the typed list: large and missing amounts, many rows, late times."""
    _, flows, use = world
    far = dt.datetime(9999, 12, 31, 23, 59, 59, 999999)
    odd = [("100.01", 3, sb.T0), ("339999999.99", 8191, far), ("340000000.00", 1, None), ("-5.25", 9000, sb.T0), (None, 2, None), ("99999999999999999999.99", 70_000, sb.T0)]
    rows = [(f"Z{i}", "ODD", n, None if a is None else Decimal(a), ts, f"C{i}", f"N{i}") for i, (a, n, ts) in enumerate(odd)]
    use = use.unionByName(spark.createDataFrame(rows, use.select("account_id", "device_id", "n", "amount", "last_ts", "customer_id", "full_name").schema))
    pairs = [(present(network.device_edges(use, 2)), network.device_edges(use, 2, TS_FORMAT)), (present(network.network_graph(flows, use)), network.network_graph(flows, use, TS_FORMAT))]
    for want, got in pairs:
        assert got.dtypes == want.dtypes
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_no_pair_formats_a_time(workspace):
    """What stands above the join of the blocks runs once per pair."""
    plan = present(build_registry()["n3"].build(workspace))._jdf.queryExecution().optimizedPlan().toString()
    assert "SHARED_DEVICE" in plan and "date_format" in plan
    assert not re.search("date_format|SHARED_DEVICE", plan[: plan.index("Join Inner")])


def test_customers_on_the_same_device_shown_per_member(workspace):
    build = build_registry()["b22"].build
    found = present(build(workspace))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "date_format" in plan and "date_format" not in plan[: plan.index("Join Inner")]
    assert found.collect() == present(QUESTIONS["b22"](workspace)).collect()


def order(r):
    return -r.total_volume_inr, r.source_node, r.target_node, r.link_type


def test_pages_follow_each_other(world):
    """From link to link over the whole list, ties included; a key that is no link itself stands between two."""
    _, flows, use = world
    want = sorted(network.network_graph(flows, use).collect(), key=order)
    for at, size in ((0, 7), (1, 30), (len(want) // 3, 11), (len(want) // 2, 25), (len(want) - 4, 10), (len(want) - 1, 5)):
        assert [order(r) for r in network.links_after(flows, use, want[at], size).collect()] == [order(r) for r in want[at + 1 : at + 1 + size]]
    middle = want[len(want) // 2]
    between = {**middle.asDict(), "target_node": middle.target_node + "!"}
    assert network.links_after(flows, use, between, 3).collect() == want[len(want) // 2 + 1 :][:3]
    assert network.links_page(flows, use, 3, 9).collect() == want[18:27]
    assert network.links_page(flows, use, 1 + len(want), 9).count() == 0


def test_pages_of_equal_amounts(spark):
    """All links of a device tie; names alone decide."""
    names = [f"B{i:02d}" for i in range(9)]
    txns = sb.transactions(spark, [dict(account_id=a, device_id=d, txn_ts=sb.T0, amount_inr="10.00") for a in names for d in ("X", "Y")])
    acc = sb.accounts(spark, [dict(account_id=a, customer_id=a) for a in names])
    cust = sb.customers(spark, [dict(customer_id=a, full_name=a) for a in names])
    flows, use = network.flow_edges(txns, acc, cust), network.device_use(txns, acc, cust).cache()
    want = sorted(network.device_edges(use).collect(), key=order)
    assert len(want) == 72
    for at in (0, 1, 14, 15, 40, 70):
        assert network.links_after(flows, use, want[at], 6).collect() == want[at + 1 : at + 7]


def test_stored_links_open_one_folder(spark, world, tmp_path):
    _, flows, use = world
    names = [f"A{i:02d}" for i in range(25)]
    owners = sb.accounts(spark, [dict(account_id=a, customer_id="C03" if a == "A04" else f"C{a[1:]}") for a in names])
    links = LinkTables(spark, str(tmp_path / "links"), buckets=8)
    links.build(owners, flows, use)
    for how in (dict(account_id="A07"), dict(customer_id="C03"), dict(account_id="EXT-BENF-001"), dict(customer_id="NOBODY")):
        got, want = (sorted(map(str, f(**how).collect())) for f in (links.neighbourhood, lambda **k: network.neighbourhood(flows, use, **k)))
        assert got == want
    plan = links.neighbourhood(account_id="A07")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"PartitionFilters: \[[^\n]*?bucket#", plan)) == plan.count("PartitionFilters: [") >= 3
    opened = links.read("ends", [links._bucket_of("C07")]).select(F.input_file_name().alias("f")).distinct().collect()
    assert opened and all(f"bucket={links._bucket_of('C07')}/" in r.f for r in opened)
    with pytest.raises(ValueError):
        links.neighbourhood()


def test_flow_edges_name_unknown_targets_by_their_own_key(world):
    _, flows, _ = world
    ext = [r for r in flows.collect() if r.target_node.startswith("EXT-")]
    assert ext and all(r.target_cust_id == r.target_node == r.target_name for r in ext)
