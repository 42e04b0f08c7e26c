"""Addresses: dotted IPv4 to a number, the ranges of both families that no request may reach, and the guard before a request."""

from __future__ import annotations

import ipaddress
import re
import socket
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import weburl

# Blocked IPv4 ranges.
BLOCKED = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24),
    ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 3),
)


def to_int(address: Column) -> Column:
    return F.aggregate(F.split(address, r"\."), F.lit(0).cast("long"), lambda acc, x: acc * 256 + x.cast("long"))


def bounds(cidr: tuple[str, int]) -> tuple[int, int]:
    start = 0
    for x in cidr[0].split("."):
        start = start * 256 + int(x)
    return start, start + (1 << (32 - cidr[1])) - 1


def blocked(number: Column) -> Column:
    """Twelve fixed ranges fold into one predicate, so the range join needs no join at all."""
    out = F.lit(False)
    for r in BLOCKED:
        out |= number.between(*bounds(r))
    return out


# Blocked IPv6 addresses and the beginnings of blocked ones (as written).
BLOCKED_V6, BLOCKED_V6_PREFIXES = ("::", "::1"), (r"(?i)^fe80:", r"(?i)^f[cd][0-9a-f]", r"(?i)^ff[0-9a-f]", r"(?i)^2001:0db8:")
_V4 = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\z"
_V6 = r"(?i)^[0-9a-f:]*:[0-9a-f:.]*\z"


def is_v4(address: Column) -> Column:
    return F.rlike(address, F.lit(_V4))


def blocked_address(address: Column) -> Column:
    """Whether an address of either family must not be reached. A host's name isn't blocked as such; nothing at all is."""
    cell = F.trim(F.coalesce(address, F.lit("")))
    mapped = F.regexp_extract(cell, r"^::ffff:(.*)\z", 1)
    v6 = cell.isin(*BLOCKED_V6)
    for p in BLOCKED_V6_PREFIXES:
        v6 |= F.rlike(cell, F.lit(p))
    v6 = F.when(mapped != "", F.when(is_v4(mapped), blocked(to_int(mapped))).otherwise(False)).otherwise(v6)
    return F.when(cell == "", True).when(is_v4(cell), blocked(to_int(cell))).when(F.rlike(cell, F.lit(_V6)), v6).otherwise(False)


class GuardError(PermissionError):
    """A request that must not be made."""


def is_blocked(address: str) -> bool:
    """The same for one address, for the guard."""
    if not address.strip():
        return True
    try:
        ip = ipaddress.ip_address(address.strip())
    except ValueError:
        return False
    if ip.version == 6 and ip.ipv4_mapped:
        ip = ip.ipv4_mapped
    if ip.version == 4:
        return any(a <= int(ip) <= b for a, b in map(bounds, BLOCKED))
    return ip.is_unspecified or ip.is_loopback or ip.is_link_local or ip.is_multicast or any(ip in ipaddress.ip_network(n) for n in ("fc00::/7", "2001:db8::/32"))


def resolve(host: str) -> list[str]:
    return sorted({info[4][0] for info in socket.getaddrinfo(host, None)})


class Guard:
    """Looks a host's addresses up and refuses blocked ones, before any connection. Lookup and predicate can be replaced."""

    def __init__(self, lookup: Callable[[str], list[str]] = resolve, blocked: Callable[[str], bool] = is_blocked):
        self.lookup, self.blocked = lookup, blocked

    def check_host(self, host: str) -> None:
        if not host.strip():
            raise GuardError("no host")
        try:
            addresses = [str(ipaddress.ip_address(host))]
        except ValueError:
            try:
                addresses = self.lookup(host)
            except OSError as error:
                raise GuardError(f"{host} has no address: {error}") from error
        if not addresses:
            raise GuardError(f"{host} has no address")
        for a in addresses:
            if self.blocked(a):
                raise GuardError(f"{host} is at a blocked address: {a}")

    def check_url(self, url: str) -> None:
        u = weburl.parsed(url or "")
        if u is None:
            kind = "no URL" if re.match("(?i)https?:", url or "") else "neither http nor https"
            raise GuardError(f"{kind}: {url}")
        host = u.host.strip("[]")
        self.check_host(host)
