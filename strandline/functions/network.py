"""Private-network predicate: addresses as numbers (IPv4) or 32 hexadecimal digits (IPv6), compared with ranges."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import let

# Loopback, private, link-local, this-network, broadcast and unique-local blocks.
PRIVATE_BLOCKS = ("127.0.0.0/8", "::1/128", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16", "fe80::/10", "0.0.0.0/8", "255.255.255.255/32", "fc00::/7")

_V4 = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"


def ipv4_number(ip: Column) -> Column:
    """An IPv4 address as a number; null for anything else."""

    def whole(p: Column) -> Column:
        return F.when(F.array_max(p) <= 255, p[0] * 16777216 + p[1] * 65536 + p[2] * 256 + p[3])

    return F.when(ip.rlike(_V4), let(F.split(ip, r"\.").cast("array<bigint>"), whole))


def ipv6_digits(ip: Column) -> Column:
    """An IPv6 address as its 32 hexadecimal digits; null for anything else.  A zone (``%eth0``) is left off."""

    def groups(text: Column) -> Column:
        return F.filter(F.split(text, ":"), lambda g: g != "")

    def spelt(tail: Column, head: Column) -> Column:
        """The last two groups, if they are written as an IPv4 address."""
        number = ipv4_number(tail)
        both = F.concat(head, F.lower(F.hex(F.shiftright(number, 16))), F.lit(":"), F.lower(F.hex(number.bitwiseAND(F.lit(65535)))))
        return F.when(tail == "", head).otherwise(both)

    def whole(text: Column) -> Column:
        short = text.contains("::")
        left, right = groups(F.substring_index(text, "::", 1)), F.when(short, groups(F.substring_index(text, "::", -1))).otherwise(F.expr("cast(array() as array<string>)"))
        missing = F.lit(8) - F.size(left) - F.size(right)
        pad = lambda a: F.array_join(F.transform(a, lambda g: F.lpad(g, 4, "0")), "")
        formed = text.rlike("^[0-9a-f:]+$") & ~text.rlike("::.*::|:::|[0-9a-f]{5}|^:[^:]|[^:]:$")
        return F.when(formed & F.when(short, missing > 0).otherwise(missing == 0), F.concat(pad(left), F.repeat(F.lit("0000"), F.greatest(missing, F.lit(0))), pad(right)))

    bare = F.lower(F.regexp_replace(ip, "%.*$", ""))
    tail = F.regexp_extract(bare, r"^.*:(\d{1,3}(?:\.\d{1,3}){3})$", 1)
    return let(F.when(ip.contains(":"), spelt(tail, F.when(tail == "", bare).otherwise(F.regexp_extract(bare, r"^(.*:)", 1)))), whole)


def is_private(ip: Column, blocks: tuple[str, ...] = PRIVATE_BLOCKS) -> Column:
    """Whether an address lies in a block; null if it is no address.  IPv4 addresses mapped into IPv6 count as such."""
    nets = [ipaddress.ip_network(b, strict=False) for b in blocks]

    def inside4(number: Column) -> Column:
        private = F.lit(False)
        for net in nets:
            if net.version == 4:
                private = private | number.between(int(net.network_address), int(net.broadcast_address))
        return F.when(number.isNotNull(), private)

    def inside6(digits: Column) -> Column:
        private = F.lit(False)
        for net in nets:
            if net.version == 6:
                private = private | digits.between(f"{int(net.network_address):032x}", f"{int(net.broadcast_address):032x}")
        mapped = let(F.conv(F.substring(digits, 25, 8), 16, 10).cast("bigint"), inside4)
        return F.when(digits.startswith("0" * 20 + "ffff"), mapped).when(digits.isNotNull(), private)

    return F.coalesce(let(ipv4_number(ip), inside4), let(ipv6_digits(ip), inside6))


def host_ip(host: Column, known: Column | None = None) -> Column:
    """Address of a host: itself if it is a literal, else what a lookup table gave."""
    literal = F.when(host.rlike(_V4) | host.contains(":"), host)
    return literal if known is None else F.coalesce(literal, known)


def blocked(ip: Column, **options) -> Column:
    """The crawler's use: an unknown address counts as private."""
    return F.coalesce(is_private(ip, **options), F.lit(True))
