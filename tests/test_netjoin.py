"""Addresses against networks of all prefix lengths, against the standard library."""

import ipaddress
import random

from eventlake.operators import netjoin
from eventlake.operators.detect import match_rules, prepare_table
from eventlake.operators.netjoin import in_networks, longest_network
from tests.test_rules import rule


def some(seed):
    rng = random.Random(seed)
    four = lambda: str(ipaddress.IPv4Address(rng.choice([rng.getrandbits(32), 0x0A000000 + rng.getrandbits(12)])))
    six = lambda: str(ipaddress.IPv6Address(rng.choice([rng.getrandbits(128), (0x20010DB8 << 96) + rng.getrandbits(6)])))
    nets = [f"{four()}/{rng.choice([0, 1, 5, 8, 21, 22, 31, 32])}" for _ in range(60)] + [f"{six()}/{rng.choice([0, 3, 32, 63, 121, 123, 127, 128])}" for _ in range(60)]
    nets += ["10.0.0.0/20", "10.0.0.1", "2001:db8::/122", "2001:db8::3", "::ffff:0:0/96"]
    addresses = [four() for _ in range(150)] + [six() for _ in range(150)] + ["::ffff:10.0.0.9", "2001:DB8::3", "10.0.0.1", "10.0.0.256", "x", "", None]
    return nets, addresses


def truth(nets, addresses):
    out = set()
    for i, a in enumerate(addresses):
        try:
            address = ipaddress.ip_address(a)
        except ValueError:
            continue
        out |= {(i, n) for n, net in enumerate(nets) if address in ipaddress.ip_network(net, strict=False)}
    return out


def test_networks_of_a_table(spark):
    nets, addresses = some(1)
    bad = ["10.0.0.0/33", "::/129", "nonsense", "10.0.0.0/x", "10.0.0.0/", None]
    table = spark.createDataFrame([*enumerate(nets), *((1000 + i, b) for i, b in enumerate(bad))], "net long, cidr string")
    events = spark.createDataFrame(list(enumerate(addresses)), "id long, ip string")
    want = truth(nets, addresses)
    got = [(r["id"], r["net"]) for r in in_networks(events, "ip", table).collect()]
    assert set(got) == want and len(got) == len(want) > 300
    length = [ipaddress.ip_network(n, strict=False).prefixlen for n in nets]
    best = {i: min((n for j, n in want if j == i), key=lambda n: (-length[n], n)) for i, _ in want}
    rows = longest_network(events, ["id"], "ip", table, "net").collect()
    assert {r["id"]: (r["net"], r["bits"]) for r in rows} == {i: (n, length[n]) for i, n in best.items()}
    assert in_networks(events, "ip", table.limit(0)).count() == 0


def test_equal_networks_are_one_before_the_join(spark, monkeypatch):
    """A table of a thousand equal networks: what is joined grows with the events alone."""
    made = []

    def watched(*args):
        made.append(in_networks(*args))
        return made[-1]

    monkeypatch.setattr(netjoin, "in_networks", watched)
    nets = spark.range(5, 1005).selectExpr("id AS net", "concat('10.', id % 200, '.0.0/8') AS cidr")
    nets = nets.union(spark.createDataFrame([(3, "10.0.0.0/16"), (None, "10.0.0.0/16"), (None, "10.0.7.0/24")], "net long, cidr string"))
    events = spark.range(200).selectExpr("id", "concat('10.0.', id % 8, '.1') AS ip")
    rows = longest_network(events.union(events), ["id"], "ip", nets, "net").collect()
    assert {r["id"]: (r["net"], r["bits"]) for r in rows} == {i: (None, 24) if i % 8 == 7 else (3, 16) for i in range(200)}
    assert len(rows) == 200 and made[0].count() <= 400 * 3


def test_network_rules_by_index(spark):
    nets, addresses = some(2)
    events = spark.createDataFrame(list(enumerate(addresses)), "id long, ip string")
    rules = [rule(sel={"ip|cidr": n}, rule_id=str(i)) for i, n in enumerate(nets)]
    rules.append(rule("a and not b", a={"ip|cidr": nets[:3]}, b={"ip|cidr": "10.0.0.0/8"}, rule_id="many"))
    hits = {(r["id"], r["rule_id"]) for r in match_rules(prepare_table(events), rules, ["id"], strategy="index").collect()}
    want = truth(nets, addresses)
    ten = {i for i, a in enumerate(addresses) if a and a.startswith("10.") and a != "10.0.0.256"}
    assert hits == {(i, str(n)) for i, n in want} | {(i, "many") for i, n in want if n < 3 and i not in ten}
