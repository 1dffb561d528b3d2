"""Canonical JSON: sorted keys, no spaces, UTF-8 kept, numbers as a double prints shortest."""

from __future__ import annotations

import hashlib
import json
import math

#: Keys that no canonical text may hold.
FORBIDDEN = frozenset({"__proto__", "constructor", "prototype"})


def _number(x: float) -> str:
    if not math.isfinite(x):
        raise ValueError("a number must be finite")
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    mantissa, _, exponent = repr(float(x)).partition("e")
    if not exponent:
        return mantissa
    e = int(exponent)
    if -7 < e < 21:  # plain digits in this range
        sign, digits = ("-", mantissa[1:]) if mantissa[0] == "-" else ("", mantissa)
        whole, _, frac = digits.partition(".")
        digits, point = whole + frac, len(whole) + e
        return sign + ("0." + "0" * -point + digits if point <= 0 else digits[:point].ljust(point, "0"))
    return f"{mantissa.removesuffix('.0')}e{'+' if e > 0 else '-'}{abs(e)}"


def canonical(value: object) -> str:
    if value is None or isinstance(value, (bool, str)):
        return json.dumps(value, ensure_ascii=False)
    if isinstance(value, int):
        return str(value) if abs(value) < 2**53 else _number(float(value))
    if isinstance(value, float):
        return _number(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, dict):
        if bad := FORBIDDEN & value.keys():
            raise ValueError(f"forbidden key {sorted(bad)[0]!r}")
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in keys) + "}"
    raise TypeError(f"{type(value).__name__} is no JSON value")


def entry_hash(entry: dict) -> str:
    """SHA-256 of an entry without its own hash."""
    return hashlib.sha256(canonical({k: v for k, v in entry.items() if k != "entry_hash"}).encode()).hexdigest()
