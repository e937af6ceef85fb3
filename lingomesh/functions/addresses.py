"""Literal IP addresses as column expressions (F14): no Python worker, one value per row.

An IPv6 text is expanded to its 32 hexadecimal digits.  Digits of one width in lower case sort like
the numbers they write, so a network is a range of such texts and a test is ``between``.
"""

from __future__ import annotations

import ipaddress
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bound

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
V4 = rf"^(?:::ffff:)?({_OCTET}(?:\.{_OCTET}){{3}})$"
# a dotted tail inside an IPv6 text has no leading zeros
_TAIL = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_DOTTED = rf"^(.*:)({_TAIL}(?:\.{_TAIL}){{3}})$"
_GROUPS = r"[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*"
_SHAPE = rf"^(?:{_GROUPS}|(?:{_GROUPS})?::(?:{_GROUPS})?)$"


def v4_number(ip: Column) -> Column:
    octets = F.split(F.regexp_extract(F.lower(ip), V4, 1), r"\.")
    return reduce(lambda x, y: x * 256 + y, [F.get(octets, F.lit(i)).try_cast("long") for i in range(4)])


def v4_in(number: Column, blocks: list[str]) -> Column:
    nets = [ipaddress.ip_network(b) for b in blocks]
    return reduce(lambda x, y: x | y, [number.between(int(n.network_address), int(n.broadcast_address)) for n in nets])


def _plain(ip: Column) -> Column:
    """Lower case, without a zone, a dotted tail written as two groups."""
    text = F.lower(F.substring_index(ip, "%", 1))

    def without_tail(t: Column) -> Column:
        n = reduce(lambda x, y: x * 256 + y, [F.get(F.split(F.regexp_extract(t, _DOTTED, 2), r"\."), F.lit(i)).try_cast("long") for i in range(4)])
        groups = F.concat(F.regexp_extract(t, _DOTTED, 1), F.lower(F.hex(F.shiftright(n, 16))), F.lit(":"), F.lower(F.hex(n.bitwiseAND(0xFFFF))))
        return F.when(t.rlike(_DOTTED), groups).otherwise(t)

    return bound(text, without_tail)


def ipv6_digits(ip: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 text; null for null and for what is no such address."""
    def groups(part: Column) -> Column:
        return F.when(part == "", F.array().cast("array<string>")).otherwise(F.transform(F.split(part, ":"), lambda g: F.lpad(g, 4, "0")))

    def expand(t: Column) -> Column:
        gap = t.contains("::")
        left, right = groups(F.substring_index(t, "::", 1)), F.when(gap, groups(F.substring_index(t, "::", -1))).otherwise(F.array().cast("array<string>"))
        missing = F.lit(8) - F.size(left) - F.size(right)
        fits = t.rlike(_SHAPE) & F.when(gap, missing >= 1).otherwise(missing == 0)
        return F.when(fits, F.concat(F.array_join(left, ""), F.repeat(F.lit("0000"), missing), F.array_join(right, "")))

    return bound(_plain(ip), expand)


def network_of(digits: Column, networks: list[tuple[str, list[str]]], otherwise: str) -> Column:
    """Name of the first entry of ``networks`` that holds an address of :func:`ipv6_digits` (entries
    may overlap; their order decides)."""
    def lookup(d: Column) -> Column:
        out = F.when(d.isNull(), F.lit(None).cast("string"))
        for name, blocks in networks:
            for net in map(ipaddress.ip_network, blocks):
                out = out.when(d.between(f"{int(net.network_address):032x}", f"{int(net.broadcast_address):032x}"), name)
        return out.otherwise(otherwise)

    return bound(digits, lookup)
