"""Key manifests and revocation lists: signed by a root key, checked for each certificate."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismveil.functions.canonical import canonical
from prismveil.operators import attestation
from prismveil.operators.compliance import utc

# The fields that a manifest and a revocation list sign.
MANIFEST_FIELDS = ("key_id", "public_key", "deployer_id", "valid_from", "valid_until", "purpose", "manifest_version")
LIST_FIELDS = ("version", "issued_at", "entries")

Signer = Callable[[bytes], bytes]


def _signed(body: dict, sign: Signer, root_public: bytes) -> dict:
    text = canonical(body).encode()
    return body | {"manifest_hash": hashlib.sha256(text).hexdigest(), "root_signature": base64.b64encode(sign(text)).decode(), "root_key_id": attestation.key_id(root_public)}


def derive_manifest(fields: dict, sign: Signer, root_public: bytes) -> dict:
    """A manifest signed by ``sign`` (a key at hand or in a module elsewhere)."""
    return _signed({k: fields.get(k) for k in MANIFEST_FIELDS}, sign, root_public)


def derive_revocations(entries: list[dict], issued_at: str, sign: Signer, root_public: bytes) -> dict:
    """A signed list of ``{"key_id", "revoked_at", "reason"}``."""
    return _signed({"version": "1", "issued_at": issued_at, "entries": entries}, sign, root_public)


def root_status(signed: dict, fields: tuple[str, ...], root_public: bytes | None) -> str:
    """``VALID``, ``INVALID`` or, without the root key, ``UNVERIFIED_NO_KEY``."""
    if root_public is None:
        return "UNVERIFIED_NO_KEY"
    try:
        text = canonical({k: signed.get(k) for k in fields}).encode()
        ok = hashlib.sha256(text).hexdigest() == signed.get("manifest_hash") and attestation.verify(root_public, text, base64.b64decode(signed["root_signature"]))
    except (KeyError, ValueError, TypeError):
        ok = False
    return "VALID" if ok else "INVALID"


def last_manifests(manifests: DataFrame, seen_at: str) -> DataFrame:
    """One manifest per key: repeats by hash once, the one seen last wins."""
    return manifests.groupBy("key_id").agg(F.max_by(F.struct(*[c for c in manifests.columns if c != "key_id"]), seen_at).alias("m")).select("key_id", "m.*")


def revocation_state(signed_at: Column, revoked_at: Column) -> Column:
    """State of a certificate: not revoked, revoked, or made before the revocation."""
    return F.when(revoked_at.isNull(), "NOT_REVOKED").when(utc(signed_at) < utc(revoked_at), "REVOKED_BUT_CERT_PREDATES").otherwise("REVOKED")


def certificates_with_state(entries: DataFrame, manifests: DataFrame, revoked: DataFrame, seen_at: str = "valid_from") -> DataFrame:
    """Signed entries with ``key_state`` (window of the last manifest of their key) and
    ``revocation_state`` (earliest revocation).  Manifests and revocations are few, one row a
    key after their aggregation."""
    last = last_manifests(manifests, seen_at).select("key_id", F.col("valid_from").alias("_from"), F.col("valid_until").alias("_until"), F.lit(True).alias("_known"))
    first = revoked.groupBy("key_id").agg(F.min("revoked_at").alias("_revoked"))
    signed = entries.filter(F.coalesce(F.col("certificate_hash") != "", F.lit(False)))
    at = utc(F.col("timestamp"))
    state = (
        F.when(F.col("_known").isNull(), "UNKNOWN_KEY").when(at.isNull(), "NO_TIME")
        .when(at < utc(F.col("_from")), "BEFORE").when(at > utc(F.col("_until")), "AFTER").otherwise("VALID")
    )
    joined = signed.join(last, "key_id", "left").join(first, "key_id", "left")
    return joined.withColumns({"key_state": state, "revocation_state": revocation_state(F.col("timestamp"), F.col("_revoked"))}).drop("_from", "_until", "_known", "_revoked")
