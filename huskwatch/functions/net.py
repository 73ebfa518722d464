"""IPv4 expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IPV4 = r"^\d{1,3}(?:\.\d{1,3}){3}$"

# Ranges that are private, loopback, link-local or reserved for special use.
NOT_PUBLIC = ["0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
              "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16",
              "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
              "255.255.255.255/32"]
BUT_PUBLIC = ["192.0.0.9/32", "192.0.0.10/32"]


def ip_to_long(ip: Column) -> Column:
    """Dotted quad as BIGINT; NULL when it is not a valid address (no octet above 255, no
    leading zero)."""
    octets = F.transform(F.split(ip, r"\."), lambda o: o.try_cast("bigint"))
    valid = ip.rlike(r"^(?:(?:0|[1-9]\d{0,2})\.){3}(?:0|[1-9]\d{0,2})$") & F.forall(octets, lambda o: o <= 255)
    return F.when(valid, F.aggregate(octets, F.lit(0).cast("bigint"), lambda acc, o: acc * 256 + o))


def _range(cidr: str) -> tuple[int, int]:
    base, bits = cidr.split("/")
    low = 0
    for part in base.split("."):
        low = low * 256 + int(part)
    return low, low + 2 ** (32 - int(bits)) - 1


def is_public(ip: Column) -> Column:
    n = ip_to_long(ip)
    cond = n.isNotNull()
    for cidr in NOT_PUBLIC:
        low, high = _range(cidr)
        cond = cond & ~n.between(low, high)
    for cidr in BUT_PUBLIC:
        cond = cond | n.between(*_range(cidr))
    return F.coalesce(cond, F.lit(False))


def subnet24(ip: Column) -> Column:
    return F.when(ip_to_long(ip).isNotNull(),
                  F.concat(F.substring_index(ip, ".", 3), F.lit(".0/24")))
