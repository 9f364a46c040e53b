"""Column expressions over addresses: private ranges, networks, flow keys."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from burstlens.functions.binding import bind

KEY = ("src_ip", "src_port", "dst_ip", "dst_port", "protocol")

# Address ranges that are not globally reachable, and the
# exceptions inside them (IANA special-purpose registries).
PRIVATE_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15",
    "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32",
)
PUBLIC_IN_V4 = ("192.0.0.9/32", "192.0.0.10/32")
PRIVATE_V6 = (
    "::1/128", "::/128", "::ffff:0:0/96", "64:ff9b:1::/48", "100::/64", "2001::/23",
    "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10",
)
PUBLIC_IN_V6 = (
    "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28",
)
MAPPED_V4 = "::ffff:0:0/96"

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"


def ipv4_number(ip: Column) -> Column:
    """Dotted quad as a long; null when it is not a valid IPv4 address."""
    def number(p: Column) -> Column:
        return sum(F.get(p, F.lit(i)).try_cast("long") * (256 ** (3 - i)) for i in range(4))

    return F.when(ip.rlike(_V4), bind(F.split(ip, r"\."), number))


def _plain_ipv6(bare: Column) -> Column:
    """Replace an embedded dotted quad by its two hexadecimal groups."""
    def groups(n: Column) -> Column:
        high, low = F.floor(n / 65536).cast("long"), n % 65536
        return F.concat(F.regexp_replace(bare, r"[0-9.]+$", ""), F.lower(F.hex(high)), F.lit(":"), F.lower(F.hex(low)))

    quad = F.regexp_extract(bare, r":([0-9]+(?:\.[0-9]+){3})$", 1)
    return F.when(bare.contains("."), bind(ipv4_number(quad), groups)).otherwise(bare)


def ipv6_hex(ip: Column) -> Column:
    """IPv6 address as 32 hex digits; null when it is not a valid address."""
    group = "[0-9a-f]{1,4}"
    run = f"({group}(:{group})*)?"

    def digits(full: Column) -> Column:
        gapped = full.contains("::")
        part = lambda side: F.filter(F.split(side, ":"), lambda x: x != "")
        left = part(F.substring_index(full, "::", 1))
        right = F.when(gapped, part(F.substring_index(full, "::", -1))).otherwise(F.array().cast("array<string>"))
        shape = full.rlike(f"^({group}:){{7}}{group}$") | full.rlike(f"^{run}::{run}$")
        return F.when(shape, bind(F.struct(left.alias("l"), right.alias("r"), gapped.alias("g")), spread))

    def spread(s: Column) -> Column:
        have = F.size(s["l"]) + F.size(s["r"])
        fill = F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - have, F.lit(0)))
        text = F.concat_ws("", F.transform(F.concat(s["l"], fill, s["r"]), lambda g: F.lpad(g, 4, "0")))
        return F.when(~s["g"] | (have <= 7), text)

    return F.when(ip.contains(":"), bind(_plain_ipv6(F.lower(F.substring_index(ip, "%", 1))), digits))


def _v4_in(number: Column, net: str) -> Column:
    n = ipaddress.IPv4Network(net, strict=False)
    return number.between(int(n.network_address), int(n.broadcast_address))


def _v6_in(digits: Column, net: str) -> Column:
    n = ipaddress.IPv6Network(net, strict=False)
    return digits.between(f"{int(n.network_address):032x}", f"{int(n.broadcast_address):032x}")


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def is_private_ip(ip: Column) -> Column:
    """True for an address in a private range; null or unparsable is false."""

    def private4(n: Column) -> Column:
        return _any([_v4_in(n, x) for x in PRIVATE_V4]) & ~_any([_v4_in(n, x) for x in PUBLIC_IN_V4])

    def private6(h: Column) -> Column:
        inside = _any([_v6_in(h, x) for x in PRIVATE_V6]) & ~_any([_v6_in(h, x) for x in PUBLIC_IN_V6])
        mapped = F.conv(F.substring(h, 25, 8), 16, 10).cast("long")
        return F.when(_v6_in(h, MAPPED_V4), bind(mapped, private4)).otherwise(inside)

    test = F.when(ip.contains(":"), bind(ipv6_hex(ip), private6)).otherwise(bind(ipv4_number(ip), private4))
    return F.coalesce(test, F.lit(False))


def network(cidr: str) -> ipaddress.IPv4Network | ipaddress.IPv6Network:
    """Check the argument of a network filter; host bits are allowed."""
    return ipaddress.ip_network(cidr, strict=False)


def in_network(ip: Column, cidr: str) -> Column:
    if network(cidr).version == 4:
        test = bind(ipv4_number(ip), lambda n: _v4_in(n, cidr))
    else:
        test = bind(ipv6_hex(ip), lambda h: _v6_in(h, cidr))
    return F.coalesce(test, F.lit(False))


def touches_network(src: Column, dst: Column, cidr: str, extra: Column | None = None) -> Column:
    """Packets of the network's IP version with either end inside it."""
    test = in_network(src, cidr) | in_network(dst, cidr)
    return test if extra is None else test & extra


def flow_key_columns(
    *,
    src_ip: str = "src_ip",
    src_port: str = "src_port",
    dst_ip: str = "dst_ip",
    dst_port: str = "dst_port",
    protocol: str = "protocol",
    bidirectional: bool = False,
) -> dict[str, Column]:
    """The five key columns: missing text is '', missing port 0, protocol upper.

    Bidirectional keys order the two ends by the text ``ip:port``.
    """
    s, d = F.coalesce(F.col(src_ip), F.lit("")), F.coalesce(F.col(dst_ip), F.lit(""))
    sp, dp = F.coalesce(F.col(src_port), F.lit(0)), F.coalesce(F.col(dst_port), F.lit(0))
    p = F.upper(F.coalesce(F.col(protocol), F.lit("")))
    if not bidirectional:
        return dict(zip(KEY, (s, sp, d, dp, p)))
    keeps = F.concat_ws(":", s, sp) <= F.concat_ws(":", d, dp)
    pick = lambda a, b: F.when(keeps, a).otherwise(b)
    return dict(zip(KEY, (pick(s, d), pick(sp, dp), pick(d, s), pick(dp, sp), p)))


def flow_direction(
    src_ip: Column,
    src_port: Column,
    dst_ip: Column,
    dst_port: Column,
    *,
    client_ip: str | None = None,
    server_ip: str | None = None,
) -> Column:
    """client_to_server, server_to_client or unknown; the first rule that fits.

    Order of the rules: client hint, server hint, private against public
    address, port 443 on one side only.
    """
    up, down = F.lit("client_to_server"), F.lit("server_to_client")
    rules: list[tuple[Column, Column]] = []
    if client_ip:
        rules += [(src_ip == client_ip, up), (dst_ip == client_ip, down)]
    if server_ip:
        rules += [(src_ip == server_ip, down), (dst_ip == server_ip, up)]
    to_443, from_443 = dst_port == 443, src_port == 443

    def by_range(p: Column) -> Column:
        return F.when(p["s"] & ~p["d"], up).when(p["d"] & ~p["s"], down)

    hinted = [F.when(test, value) for test, value in rules]
    private = bind(F.struct(is_private_ip(src_ip).alias("s"), is_private_ip(dst_ip).alias("d")), by_range)
    ports = F.when(to_443 & ~from_443, up).when(from_443 & ~to_443, down)
    return F.coalesce(*hinted, private, ports, F.lit("unknown"))


def direction_code(direction: Column) -> Column:
    """+1 for client to server, -1 for everything else, unknown included."""
    return F.when(direction == "client_to_server", 1).otherwise(-1)
