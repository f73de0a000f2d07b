"""Addresses against a table of networks: the longest network that holds each.

Networks are prefixes, so those that hold an address are, for each length that
the table has, one prefix of the address itself.  The match is an equality join
on (family, length, prefix): no range join, no table in the driver, and a list of
any size.  At most 162 lengths exist; those that occur are the only thing read
beforehand.  Addresses are matched once each, however many rows they have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.let import let
from ..functions.network import ipv4_number, ipv6_digits

_MAPPED = "0" * 20 + "ffff"


def _bits(ip: Column) -> Column:
    """struct<family, hi, lo>: the address as bits from the left, null if it is none; IPv4 in IPv6 counts as IPv4."""

    def four(number: Column) -> Column:
        return F.when(number.isNotNull(), F.struct(F.lit(4).alias("family"), F.shiftleft(number, 32).alias("hi"), F.lit(0).cast("long").alias("lo")))

    def six(digits: Column) -> Column:
        half = lambda start: F.conv(F.substring(digits, start, 16), 16, -10).cast("long")
        number = F.conv(F.substring(digits, 25, 8), 16, 10).cast("long")
        mapped = F.struct(F.lit(4).alias("family"), F.shiftleft(number, 32).alias("hi"), F.lit(0).cast("long").alias("lo"))
        plain = F.struct(F.lit(6).alias("family"), half(1).alias("hi"), half(17).alias("lo"))
        return F.when(digits.startswith(_MAPPED), mapped).when(digits.isNotNull(), plain)

    return F.coalesce(let(ipv4_number(ip), four), let(ipv6_digits(ip), six))


def _prefix(hi: Column, lo: Column, length: int) -> tuple[Column, Column]:
    """The first ``length`` bits of an address."""
    zero = F.lit(0).cast("long")
    left = zero if length == 0 else F.shiftrightunsigned(hi, 64 - length) if length < 64 else hi
    return left, F.shiftrightunsigned(lo, 128 - length) if length > 64 else zero


def parsed(networks: DataFrame) -> DataFrame:
    """``networks`` (net: ``address/length`` or an address alone, ...) with family, length and prefix; others are left out."""
    named = networks.withColumn("_bits", _bits(F.split_part("net", F.lit("/"), F.lit(1)))).where("_bits is not null")
    most = F.when(F.col("_bits.family") == 4, 32).otherwise(128)
    written = F.when(F.instr("net", "/") > 0, F.when(F.substring_index("net", "/", -1).rlike(r"^\d{1,3}$"), F.substring_index("net", "/", -1))).otherwise(most.cast("string")).cast("int")
    # the length of a network of IPv4 in IPv6 counts from its own 32 bits
    mapped = (F.col("_bits.family") == 4) & F.col("net").contains(":") & (F.instr("net", "/") > 0)
    sized = named.withColumn("_len", F.when(mapped, written - 96).otherwise(written)).where((F.col("_len") >= 0) & (F.col("_len") <= most))
    hi, lo, length = F.col("_bits.hi"), F.col("_bits.lo"), F.col("_len")
    zero = F.lit(0).cast("long")
    cut = lambda bits, n: F.call_function("shiftrightunsigned", bits, n)
    left = F.when(length == 0, zero).when(length < 64, cut(hi, 64 - length)).otherwise(hi)
    right = F.when(length > 64, cut(lo, 128 - length)).otherwise(zero)
    return sized.select(*networks.columns, F.col("_bits.family").alias("_family"), "_len", left.alias("_hi"), right.alias("_lo"))


def match(addresses: DataFrame, networks: DataFrame, ip: str = "ip") -> DataFrame:
    """``addresses`` with ``net``: the longest network of ``networks`` (net) that holds ``ip``; null if none does.

    Of equal networks written differently the first in order stands.
    """
    known = parsed(networks.select("net")).groupBy("_family", "_len", "_hi", "_lo").agg(F.min("net").alias("net"))
    lengths = [tuple(r) for r in known.select("_family", "_len").distinct().sort("_family", "_len").collect()]
    each = addresses.select(F.col(ip).alias("_matched")).where("_matched is not null").distinct().withColumn("_b", _bits(F.col("_matched"))).where("_b is not null")
    if not lengths:
        return addresses.withColumn("net", F.lit(None).cast("string"))

    # only numbers are spread over the lengths and shuffled: the length and the address, of which its prefix is made at the join
    wide = any(length > 64 for _, length in lengths)
    key = ["_kind", "_hi", "_lo"] if wide else ["_kind", "_hi"]
    kind = lambda family, length: family * 1000 + length
    nets = known.select((F.col("_family") * 1000 + F.col("_len")).cast("int").alias("_kind"), *key[1:], "net")

    def held(family: int, length: int) -> Column:
        hi, lo = _prefix(F.col("_b.hi"), F.col("_b.lo"), length)
        return F.when(F.col("_b.family") == family, F.struct(F.lit(kind(family, length)).alias("_kind"), hi.alias("_hi"), *([lo.alias("_lo")] if wide else [])))

    own = ["_b.hi", *(["_b.lo"] if any(family == 6 for family, _ in lengths) else [])]
    at = [F.col(c).alias(f"_at_{c[-2:]}") for c in own]
    # addresses that are written differently may be one number; they meet again by family and bits
    each = each.select(F.col("_b.family").alias("_f"), *at, "_b").distinct()
    spread = each.select(*[c for c in each.columns if c not in ("_b", "_f")], F.explode(F.array_compact(F.array(*[held(*x) for x in lengths]))).alias("p")).select(*[c for c in each.columns if c not in ("_b", "_f")], "p.*")
    bits = [c for c in each.columns if c not in ("_b", "_f")]
    found = spread.join(nets, key).groupBy(F.floor(F.col("_kind") / 1000).cast("int").alias("_f"), *bits).agg(F.max_by("net", "_kind").alias("net"))
    named = addresses.withColumn("_b", _bits(F.col(ip))).withColumn("_f", F.col("_b.family")).withColumns({f"_at_{c[-2:]}": F.col(c) for c in own}).drop("_b")
    return named.join(found, ["_f", *bits], "left").select(*addresses.columns, "net")
