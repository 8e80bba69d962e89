"""Deterministic identifiers and content hashes as column expressions.

Everything here stays inside Catalyst: no Python runs per row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# Namespaces under which composite corpora and stored bundles are named.
COMPOSITE_NAMESPACE = "a784b4b7-28bc-4f82-a28a-c47c5d74e969"
BUNDLE_NAMESPACE = "40294f47-4eb0-4f26-8241-64d9258e01d4"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _v5(namespace_bytes: Column, name: Column) -> Column:
    digest = F.sha1(F.concat(namespace_bytes, F.encode(name, "UTF-8")))

    def spelled(d: Column) -> Column:
        # Version nibble is 5; the variant nibble keeps its low two bits under 10xx.
        variant = F.translate(F.substring(d, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
        return F.concat(F.substring(d, 1, 8), F.lit("-"), F.substring(d, 9, 4), F.lit("-5"), F.substring(d, 14, 3), F.lit("-"),
                        variant, F.substring(d, 18, 3), F.lit("-"), F.substring(d, 21, 12))

    # Through a one-element array the digest is computed once, though six pieces of it are used;
    # ids nest, so copies would multiply.
    return F.transform(F.array(digest), spelled)[0]


def uuid5_col(namespace: str, name: Column | str) -> Column:
    """UUIDv5 of ``name`` in a constant namespace."""
    return _v5(F.lit(uuid.UUID(namespace).bytes), _col(name))


def uuid5_of(namespace: Column, name: Column) -> Column:
    """UUIDv5 where the namespace UUID is itself a column."""
    return _v5(F.unhex(F.replace(namespace, F.lit("-"), F.lit(""))), name)


def derived_uuid_col(namespace: str, kind: str, *parts: Column | str) -> Column:
    """UUIDv5 of ``kind:part|part|...``; a null part counts as empty."""
    key = F.concat_ws("|", *[F.coalesce(_col(p).cast("string"), F.lit("")) for p in parts])
    return uuid5_col(namespace, F.concat(F.lit(f"{kind}:"), key))


def packed(value: Column | str) -> Column:
    """The 16 bytes of a UUID in its usual lower-case spelling, to be shuffled instead of 36 characters; see :func:`spelled`.

    Any other text keeps its bytes behind 17 zero bytes, so that no two texts are packed alike.
    """
    value = _col(value)
    usual = value.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$") & (F.length(value) == 36)
    return F.when(usual, F.unhex(F.replace(value, F.lit("-"), F.lit("")))).otherwise(F.concat(F.lit(bytes(17)), value.cast("binary")))


def spelled(value: Column | str) -> Column:
    """The text that :func:`packed` was given."""
    value = _col(value)
    digits = F.regexp_replace(F.lower(F.hex(value)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(F.octet_length(value) == 16, digits).otherwise(F.substring(value, 18, 2147483647).cast("string"))


def content_hash(title: Column | str, description: Column | str) -> Column:
    """SHA-256 of title, NUL, description."""
    return F.sha2(F.encode(F.concat(_col(title), F.lit("\0"), _col(description)), "UTF-8"), 256)


def canonical_json(**fields: Column) -> Column:
    """Compact JSON object with its keys in sorted order, nulls kept."""
    members = [fields[name].alias(name) for name in sorted(fields)]
    return F.to_json(F.struct(*members), {"ignoreNullFields": "false"})


def object_content_hash(title: Column | str, description: Column | str) -> Column:
    """Hash used by the branch store: SHA-256 of the canonical JSON of both texts."""
    return F.sha2(canonical_json(title=_col(title), description=_col(description)), 256)


def input_hash(tool: Column, arguments_json: Column, change_set: Column) -> Column:
    """Hash of a request's canonical input.

    ``arguments_json`` is already canonical JSON text, so it is spliced in whole.
    """
    change = F.coalesce(F.concat(F.lit('"'), change_set, F.lit('"')), F.lit("null"))
    body = F.concat(
        F.lit('{"arguments":'), arguments_json,
        F.lit(',"change_set_id":'), change,
        F.lit(',"tool":"'), tool, F.lit('"}'),
    )
    return F.sha2(body, 256)


def ns_time(base: Column, nanos: Column) -> Column:
    """Fixed-width nanosecond time text: ``base`` plus a count of nanoseconds."""
    per_second = F.lit(1_000_000_000)
    seconds = F.floor(nanos / per_second)
    whole = F.timestamp_seconds(F.unix_timestamp(base) + seconds)
    fraction = F.lpad(F.pmod(nanos.cast("long"), per_second).cast("string"), 9, "0")
    return F.concat(F.date_format(whole, "yyyy-MM-dd'T'HH:mm:ss."), fraction, F.lit("Z"))


NS_TIME_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{9}Z$"
