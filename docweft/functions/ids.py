"""Deterministic identities: content hashes, version-5 UUIDs and label identifiers, all as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The URL namespace of RFC 4122.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
SLUG = "^[a-z0-9]+(-[a-z0-9]+)*$"
CITE_KEY = r"(?U)^\w[\w.-]{0,159}$"
# Names that some file systems reserve, and artifact kinds.
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"{d}{i}" for d in ("COM", "LPT") for i in range(1, 10)))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def uuid5(key: Column, namespace: str = URL_NAMESPACE) -> Column:
    """The version-5 UUID of a key: SHA-1 over namespace and key, with version and variant bits set."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(key, "utf-8")))
    variant = F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lower(F.hex(variant)), F.substring(h, 19, 2)), F.substring(h, 21, 12))


def row_id(document: Column, kind: str, *parts: Column) -> Column:
    """The stable id of a derived row: document, kind and the parts of its own key."""
    return uuid5(F.concat_ws(":", F.lit("docweft"), document.cast("string"), F.lit(kind), *(p.cast("string") for p in parts)))


def valid_slug(value: Column) -> Column:
    return F.coalesce(value.rlike(SLUG), F.lit(False))


def valid_cite_key(value: Column) -> Column:
    """File-name safe: word characters, dots and dashes, not ending in a dot, not a reserved device name."""
    return F.coalesce(value.rlike(CITE_KEY) & ~value.endswith(".") & ~F.upper(F.substring_index(value, ".", 1)).isin(*RESERVED), F.lit(False))


def valid_id(value: Column, kinds: tuple[str, ...]) -> Column:
    """kind:rest with a known kind, and a rest without control characters, slashes, hash signs or the unknown mark."""
    kind = F.substring_index(value, ":", 1)
    return F.coalesce(kind.isin(*kinds) & value.rlike(r"^[^:]+:[^\x00-\x1f/\\#]+$") & ~value.contains("TODO"), F.lit(False))


def topic_id(label: Column) -> Column:
    """topic:label where that is a valid id, else the label's hash."""
    full = F.when(label.startswith("topic:"), label).otherwise(F.concat(F.lit("topic:"), label))
    return F.when(valid_id(full, ("topic",)), full).otherwise(F.concat(F.lit("topic:label-"), F.substring(F.sha2(label, 256), 1, 16)))
