"""Merkle trees level by level, key derivation and Ed25519 signatures."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismveil.plans.storage import materialise

# ---- Merkle -------------------------------------------------------------------------------


def merkle_roots(leaves: DataFrame, batch: str, position: str, leaf: str) -> DataFrame:
    """``batch, n_leaves, root``: pairs are hashed as texts, left then right; an odd last node goes
    up as it is.

    Each level halves the rows, so there are log2 rounds of one aggregation.  Positions are dense
    per batch (a window over slim rows); a hot batch is many groups of two, not one.
    """
    w = Window.partitionBy("batch").orderBy("position", "h")
    nodes = leaves.select(F.col(batch).alias("batch"), F.col(position).alias("position"), F.col(leaf).alias("h")).withColumn("pos", F.row_number().over(w).cast("bigint") - 1).drop("position")
    nodes = materialise(nodes, "merkle-0")
    sizes = nodes.groupBy("batch").agg(F.count(F.lit(1)).alias("n_leaves"))
    longest = sizes.agg(F.max("n_leaves")).first()[0] or 0
    levels = max(0, (longest - 1).bit_length())
    for level in range(levels):
        up = nodes.groupBy("batch", F.floor(F.col("pos") / 2).alias("pos")).agg(F.min_by("h", "pos").alias("l"), F.max_by("h", "pos").alias("r"), F.count(F.lit(1)).alias("n"))
        nodes = up.select("batch", "pos", F.when(F.col("n") == 1, F.col("l")).otherwise(F.sha2(F.concat("l", "r"), 256)).alias("h"))
        if level % 4 == 3:  # cut the lineage now and then
            nodes = materialise(nodes, f"merkle-{level + 1}")
    return nodes.join(sizes, nodes["batch"].eqNullSafe(sizes["batch"])).select(nodes["batch"].alias(batch), "n_leaves", F.col("h").alias("root"))


def merkle_proof(hashes: list[str], index: int) -> list[tuple[str, str]]:
    """Siblings of a leaf from the bottom up, each with its side."""
    proof, level = [], list(hashes)
    while len(level) > 1:
        other = index ^ 1
        if other < len(level):
            proof.append(("left" if other < index else "right", level[other]))
        level = [hashlib.sha256("".join(level[i : i + 2]).encode()).hexdigest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        index //= 2
    return proof


def merkle_verify(leaf: str, proof: list[tuple[str, str]], root: str) -> bool:
    h = leaf
    for side, other in proof:
        h = hashlib.sha256((other + h if side == "left" else h + other).encode()).hexdigest()
    return hmac.compare_digest(h, root)


# ---- keys ---------------------------------------------------------------------------------


def derive_key(secret: bytes, info: bytes = b"entity-hash", length: int = 32, salt: bytes = bytes(32)) -> bytes:
    """HKDF-SHA256."""
    prk, out, block, i = hmac.digest(salt, secret, "sha256"), b"", b"", 1
    while len(out) < length:
        block = hmac.digest(prk, block + info + bytes((i,)), "sha256")
        out, i = out + block, i + 1
    return out[:length]


# The curve of RFC 8032.
_P = 2**255 - 19
_L = 2**252 + 27742317777372353535851937790883648493
_D = -121665 * pow(121666, -1, _P) % _P
_ROOT = pow(2, (_P - 1) // 4, _P)


def _point(data: bytes) -> tuple[int, int, int, int] | None:
    y = int.from_bytes(data, "little")
    sign, y = y >> 255, y & ((1 << 255) - 1)
    if y >= _P:
        return None
    square = (y * y - 1) * pow(_D * y * y + 1, -1, _P) % _P
    x = pow(square, (_P + 3) // 8, _P)
    if (x * x - square) % _P:
        x = x * _ROOT % _P
    if (x * x - square) % _P or (x == 0 and sign):
        return None
    x = _P - x if x & 1 != sign else x
    return x, y, 1, x * y % _P


def _sum(p: tuple, q: tuple) -> tuple:
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % _P, (p[1] + p[0]) * (q[1] + q[0]) % _P
    c, d = 2 * p[3] * q[3] * _D % _P, 2 * p[2] * q[2] % _P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % _P, g * h % _P, f * g % _P, e * h % _P


def _times(k: int, p: tuple) -> tuple:
    out = (0, 1, 1, 0)
    while k:
        if k & 1:
            out = _sum(out, p)
        p, k = _sum(p, p), k >> 1
    return out


def _bytes(p: tuple) -> bytes:
    z = pow(p[2], -1, _P)
    return (p[1] * z % _P | (p[0] * z % _P & 1) << 255).to_bytes(32, "little")


_BASE = _point((4 * pow(5, -1, _P) % _P).to_bytes(32, "little"))


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    a = int.from_bytes(h[:32], "little") & ((1 << 254) - 8) | 1 << 254
    return a, h[32:]


def public_key(seed: bytes) -> bytes:
    return _bytes(_times(_secret(seed)[0], _BASE))


def key_id(public: bytes) -> str:
    return hashlib.sha256(public).hexdigest()[:16]


def sign(seed: bytes, message: bytes) -> bytes:
    a, prefix = _secret(seed)
    pub = _bytes(_times(a, _BASE))
    r = int.from_bytes(hashlib.sha512(prefix + message).digest(), "little") % _L
    big = _bytes(_times(r, _BASE))
    k = int.from_bytes(hashlib.sha512(big + pub + message).digest(), "little") % _L
    return big + ((r + k * a) % _L).to_bytes(32, "little")


def verify(public: bytes, message: bytes, signature: bytes) -> bool:
    if len(public) != 32 or len(signature) != 64:
        return False
    a, r, s = _point(public), _point(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= _L:
        return False
    k = int.from_bytes(hashlib.sha512(signature[:32] + public + message).digest(), "little") % _L
    left, right = _times(s, _BASE), _sum(r, _times(k, a))
    return (left[0] * right[2] - right[0] * left[2]) % _P == 0 and (left[1] * right[2] - right[1] * left[2]) % _P == 0


# The signed fields of a certificate.
SIGNED = ("version", "timestamp", "input_hash", "output_hash", "entity_count", "categories", "detection_passes", "mode", "key_id", "nonce")


def certificate(seed: bytes, fields: dict) -> dict:
    """A signed certificate over the canonical JSON of its ``SIGNED`` fields."""
    import base64

    from prismveil.functions.canonical import canonical

    pub = public_key(seed)
    body = {k: fields.get(k) for k in SIGNED} | {"key_id": key_id(pub)}
    return body | {"signature": base64.b64encode(sign(seed, canonical(body).encode())).decode(), "public_key": base64.b64encode(pub).decode()}


def verify_certificate(cert: dict, public: bytes | None = None) -> bool:
    import base64

    from prismveil.functions.canonical import canonical

    try:
        key = public or base64.b64decode(cert["public_key"])
        return verify(key, canonical({k: cert.get(k) for k in SIGNED}).encode(), base64.b64decode(cert["signature"]))
    except (KeyError, ValueError, TypeError):
        return False


def with_valid_signature(certificates: DataFrame, body: str, signature: str, public: str, out: str = "valid") -> DataFrame:
    """``certificates`` with the verdict on base64 ``signature`` and ``public`` over the text
    ``body``; nulls and broken base64 are not valid."""
    import base64

    @F.pandas_udf("boolean")
    def check(b: pd.Series, s: pd.Series, p: pd.Series) -> pd.Series:
        def one(b: str | None, s: str | None, p: str | None) -> bool:
            try:
                return verify(base64.b64decode(p), b.encode(), base64.b64decode(s))
            except (ValueError, TypeError, AttributeError):
                return False

        return pd.Series([one(*x) for x in zip(b, s, p)])

    return certificates.withColumn(out, check(body, signature, public))
