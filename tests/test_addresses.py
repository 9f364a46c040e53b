"""Address rules against the standard library."""

import ipaddress
import random

from pyspark.sql import functions as F

from burstlens.functions.addresses import PRIVATE_V4, PRIVATE_V6, PUBLIC_IN_V6, in_network, is_private_ip

ODD = ["::", "::1", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "fe80::1%eth0", "1::2::3", "abcd", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7::",
       "01.2.3.4", "1.2.3", "256.1.1.1", "", "1.2.3.4.5", "12345::", "::1.2.3.4", "1:2:3:4:5:6:1.2.3.4", ":::", "1::2:", "192.0.0.9"]


def sample():
    rng = random.Random(4)
    out = ODD + [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(200)]
    out += [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(100)]
    for text in (*PRIVATE_V4, *PRIVATE_V6, *PUBLIC_IN_V6):
        net = ipaddress.ip_network(text)
        kind = type(net[0])
        for n in (int(net[0]) - 1, int(net[0]), int(net[-1]), int(net[-1]) + 1):
            if 0 <= n < 2**net.max_prefixlen:
                out.append(str(kind(n)))
    return out


def ask(text, test):
    try:
        return test(ipaddress.ip_address(text))
    except ValueError:
        return False


def test_private(spark):
    df = spark.createDataFrame([(x,) for x in sample()] + [(None,)], "ip string")
    for r in df.select("ip", is_private_ip(F.col("ip")).alias("p")).collect():
        assert r.p == (r.ip is not None and ask(r.ip, lambda a: a.is_private)), r.ip


def test_networks(spark):
    df = spark.createDataFrame([(x,) for x in sample()], "ip string")
    for cidr in ("10.3.2.1/9", "0.0.0.0/0", "8.8.8.8/32", "2001:db8::7/33", "fe80::/10"):
        net = ipaddress.ip_network(cidr, strict=False)
        for r in df.select("ip", in_network(F.col("ip"), cidr).alias("p")).collect():
            assert r.p == ask(r.ip.split("%")[0], lambda a: a in net), (cidr, r.ip)
