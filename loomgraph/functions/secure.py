"""Field encryption as Column expressions: AES-256-GCM under the hash of a master key."""

from __future__ import annotations

import hmac
import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "enc:v1:"
MASK = "[REDACTED_SECRET]"
VAULTS = ("vault://", "env://")


def master_key(given: str | None = None, variable: str = "LOOMGRAPH_MASTER_KEY", path: str | None = None) -> str:
    """The key given, else of the environment, else of a file; there is no default key."""
    found = given or os.environ.get(variable)
    if not found and path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            found = f.read().strip()
    if not found:
        raise ValueError("no master key: give one, set the variable or name a file")
    return found


def _key(master: str) -> Column:
    return F.unhex(F.sha2(F.lit(master).cast("binary"), 256))


def is_vault_reference(text: Column) -> Column:
    return text.startswith(VAULTS[0]) | text.startswith(VAULTS[1])


def encrypt(text: Column, master: str) -> Column:
    """``enc:v1:`` and base64 of nonce, ciphertext and tag; encrypted texts, vault references and '' stay as they are."""
    sealed = F.concat(F.lit(PREFIX), F.regexp_replace(F.base64(F.aes_encrypt(text.cast("binary"), _key(master), F.lit("GCM"))), r"\s", ""))
    return F.when((text == "") | text.startswith(PREFIX) | is_vault_reference(text), text).otherwise(sealed)


def decrypt(text: Column, master: str) -> Column:
    """The plain text; texts without the prefix pass; null where the tag, the key or the encoding is wrong."""
    raw = F.unbase64(F.when(text.rlike(r"^enc:v1:[A-Za-z0-9+/]+={0,2}$"), F.substring(text, len(PREFIX) + 1, 1 << 30)))
    return F.when(text.startswith(PREFIX), F.try_aes_decrypt(raw, _key(master), F.lit("GCM")).cast("string")).otherwise(text)


def mask(text: Column, secret: Column, include: bool = False) -> Column:
    return text if include else F.when(secret | text.startswith(PREFIX), F.lit(MASK)).otherwise(text)


#: Paths that need no key.
PUBLIC_PATHS = ("/health", "/api/v1/memory/health", "/api/v1/consolidation/health")


def authorised(path: str, headers: Mapping[str, str], key: str, public: Sequence[str] = PUBLIC_PATHS) -> bool:
    """Whether a request may pass: no key is set, the path is public (a slash at its end doesn't matter), or the key
    comes in ``X-API-Key`` or, where that is missing, as a bearer token."""
    key = key.strip()
    if not key or path.rstrip("/") in {p.strip().rstrip("/") for p in public}:
        return True
    low = {k.lower(): v for k, v in headers.items()}
    kind, _, bearer = low.get("authorization", "").partition(" ")
    given = (low.get("x-api-key") or (bearer if kind.lower() == "bearer" else "")).strip()
    return bool(given) and hmac.compare_digest(given.encode(), key.encode())
