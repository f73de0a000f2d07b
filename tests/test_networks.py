import ipaddress
import random

from strandline.operators import crawl
from strandline.operators.networks import match, parsed


def longest(ip, nets):
    try:
        at = ipaddress.ip_address(ip)
    except (ValueError, TypeError):
        return None
    at = getattr(at, "ipv4_mapped", None) or at
    found = [n for n in nets if n.version == at.version and at in n]
    return max(found, key=lambda n: n.prefixlen, default=None)


def test_longest_prefix_against_all_networks(spark):
    rnd = random.Random(6)
    nets = [ipaddress.ip_network((rnd.getrandbits(32), rnd.randint(0, 32)), strict=False) for _ in range(150)] + [ipaddress.ip_network((rnd.getrandbits(128), rnd.randint(0, 128)), strict=False) for _ in range(150)]
    nets += [ipaddress.ip_network(n) for n in ("10.0.0.0/8", "10.1.0.0/16", "10.1.2.3/32", "2001:db8::/32", "2001:db8::/64", "2001:db8::/65", "2001:db8::1/128")]
    rows = [(str(n),) for n in nets] + [("10.0.0.0/8",), ("no network",), ("1.2.3.4/40",), ("1.2.3.4/x",), (None,)]
    ips = [str(n[rnd.randrange(min(n.num_addresses, 1 << 20))]) for n in nets] + [str(ipaddress.ip_address(rnd.getrandbits(32))) for _ in range(50)] + [str(ipaddress.IPv6Address(rnd.getrandbits(128))) for _ in range(50)]
    ips += ["10.1.2.3", "10.1.2.4", "10.9.9.9", "::ffff:10.1.2.3", "2001:db8::1", "2001:db8::2", "2001:db8:0:0:8000::", "nothing", "", None, "10.1.2.3"]
    frame = spark.createDataFrame([(i, ip, "x") for i, ip in enumerate(ips)], "n long, ip string, other string")
    got = {r.n: r.net for r in match(frame, spark.createDataFrame(rows, "net string")).collect()}
    assert len(got) == len(ips)
    for i, ip in enumerate(ips):
        want = longest(ip, nets)
        assert got[i] == (str(want) if want else None), ip
    plan = match(frame, spark.createDataFrame(rows, "net string"))._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_forms_and_empty_lists(spark):
    nets = spark.createDataFrame([("9.9.9.9",), ("::1",), ("::ffff:8.8.0.0/112",)], "net string")
    assert {(r.net, r._family, r._len) for r in parsed(nets).collect()} == {("9.9.9.9", 4, 32), ("::1", 6, 128), ("::ffff:8.8.0.0/112", 4, 16)}
    ips = spark.createDataFrame([("8.8.4.4",), ("0:0:0:0:0:0:0:1",)], "ip string")
    assert {(r.ip, r.net) for r in match(ips, nets).collect()} == {("8.8.4.4", "::ffff:8.8.0.0/112"), ("0:0:0:0:0:0:0:1", "::1")}
    assert {r.net for r in match(ips, nets.limit(0)).collect()} == {None} and match(ips.limit(0), nets).count() == 0


def test_listed_networks_are_refused(spark):
    links = spark.createDataFrame([("http://a.example.com/",), ("http://b.example.com/",), ("http://9.9.8.7/",), ("http://9.9.9.7/",), ("http://10.0.0.1/",)], "url string")
    hosts = spark.createDataFrame([("a.example.com", "8.8.8.8"), ("b.example.com", "8.9.8.8")], "host string, ip string")
    nets = spark.createDataFrame([("8.8.0.0/16",), ("9.9.9.0/24",)], "net string")
    assert {r.url for r in crawl.public_only(links, hosts, networks=nets).collect()} == {"http://b.example.com/", "http://9.9.8.7/"}
    assert {r.url for r in crawl.public_only(links, networks=nets).collect()} == {"http://9.9.8.7/"}
