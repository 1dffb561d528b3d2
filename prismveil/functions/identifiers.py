"""Identifiers, times and addresses as columns."""

from __future__ import annotations

import ipaddress
import secrets

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the alphabet of sortable ids.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def ulid(milliseconds: int, entropy: bytes | None = None) -> str:
    """A sortable id: 48 bits of time and 80 random bits in 26 characters."""
    entropy = secrets.token_bytes(10) if entropy is None else entropy
    if not 0 <= milliseconds < 1 << 48 or len(entropy) != 10:
        raise ValueError("48 bits of time and 10 bytes of entropy")
    n = milliseconds << 80 | int.from_bytes(entropy, "big")
    return "".join(CROCKFORD[n >> s & 31] for s in range(125, -1, -5))


def ulid_of(milliseconds: Column, key: Column) -> Column:
    """The same from a time and a key, always the same for the same key: native."""
    bits = lambda hex_text, n: F.lpad(F.conv(hex_text, 16, 2), n, "0")
    digest = F.sha2(key.cast("string"), 256)
    text = F.concat(F.lit("00"), F.lpad(F.conv(milliseconds.cast("string"), 10, 2), 48, "0"), bits(F.substring(digest, 1, 10), 40), bits(F.substring(digest, 11, 10), 40))
    digits = F.transform(F.sequence(F.lit(0), F.lit(25)), lambda i: F.lit(CROCKFORD).substr(F.conv(text.substr(i * 5 + 1, F.lit(5)), 2, 10).cast("int") + 1, F.lit(1)))
    return F.when(milliseconds.isNotNull() & key.isNotNull(), F.array_join(digits, ""))


def version_pin(model: Column, deployment: Column, instruction: Column) -> Column:
    """``model@deployment/instruction``; null unless all three are there."""
    present = F.lit(True)
    for c in (model, deployment, instruction):
        present &= F.coalesce(c != "", F.lit(False))
    return F.when(present, F.format_string("%s@%s/%s", model, deployment, instruction))


def valid_decision_id(value: Column) -> Column:
    """1 to 64 printable ASCII characters."""
    return F.coalesce(value.rlike(r"\A[\x20-\x7E]{1,64}\z"), F.lit(False))


def generalized_time(value: Column) -> Column:
    """``YYYYMMDDhhmmss[.f]Z`` as ISO 8601; null if it is none."""
    pattern = r"\A(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})(\.\d+)?Z\z"
    return F.when(value.rlike(pattern), F.regexp_replace(value, pattern, "$1-$2-$3T$4:$5:$6$7Z"))


def ipv4_number(value: Column) -> Column:
    """An IPv4 address as a number; null if it is none."""
    parts = F.split(value, r"\.")
    number = F.aggregate(parts, F.lit(0).cast("bigint"), lambda acc, p: acc * 256 + p.try_cast("int"))
    return F.when(value.rlike(r"\A(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\z"), number)


def may_connect(address: str, allow_remote: bool = False) -> bool:
    """Is an address fit for a local service?  Loopback always; private and public ones only if
    remote is allowed; link-local, multicast, unspecified and reserved ones never.  An IPv4
    address inside an IPv6 one counts as itself."""
    try:
        ip = ipaddress.ip_address(address)
    except ValueError:
        return False
    ip = getattr(ip, "ipv4_mapped", None) or ip
    if ip.is_loopback:
        return True
    if ip.is_link_local or ip.is_multicast or ip.is_unspecified or ip.is_reserved:
        return False
    return allow_remote
