"""Hashes, signed keys and size plans as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PART_BYTES, MOST_PARTS = 10 << 20, 10_000
#: Fixed value: pixels of the largest image that is scaled.
MOST_PIXELS = 40_000_000


def object_path(sha256: Column) -> Column:
    """The canonical place of content by its hash."""
    return F.concat(F.lit("objects/sha256/"), F.substring(sha256, 1, 2), F.lit("/"), sha256)


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Hex HMAC-SHA-256 of a string or binary column under a driver-side key."""
    from hashlib import sha256

    block = (sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def base64url(value: Column) -> Column:
    """URL-safe base64 without padding."""
    return F.rtrim(F.translate(F.base64(value), "+/=", "-_ "))


def from_base64url(text: Column) -> Column:
    """Bytes of URL-safe base64 without padding; null for any other text."""
    valid = text.rlike(r"^[A-Za-z0-9_-]*\z") & (F.length(text) % 4 != 1)
    return F.when(valid, F.unbase64(F.translate(text, "-_", "+/")))


def access_token(key: bytes, share_id: Column, expires_at: Column) -> Column:
    """A signed token by which a share can be read until ``expires_at`` (seconds since 1970)."""
    claims = base64url(F.to_json(F.struct(share_id.alias("share_id"), expires_at.alias("expires_at"))).cast("binary"))
    return F.concat(claims, F.lit("."), base64url(F.unhex(hmac_sha256(key, claims))))


def accessed_share(key: bytes, token: Column, now: Column) -> Column:
    """The share that a token opens at ``now`` (seconds since 1970); null if it is malformed, signed otherwise, or expired."""
    parts = F.split(token, r"\.", -1)
    claims, signature = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    read = F.from_json(F.try_validate_utf8(from_base64url(claims).cast("string")), "share_id string, expires_at long")
    genuine = F.lower(F.hex(from_base64url(signature))) == hmac_sha256(key, claims)
    return F.when((F.size(parts) == 2) & genuine & (now < read["expires_at"]), read["share_id"])


def part_size(size: Column) -> Column:
    """Bytes of an upload part: 10 MiB, doubled until at most ten thousand parts are enough."""
    doublings = sum((F.when(size.cast("double") > float(PART_BYTES) * MOST_PARTS * 2.0**j, 1).otherwise(0) for j in range(40)), F.lit(0))
    return (F.lit(float(PART_BYTES)) * F.pow(F.lit(2.0), doublings)).cast("long")


def part_count(size: Column) -> Column:
    return F.ceil(size / part_size(size)).cast("long")


def scaled_edges(width: Column, height: Column, most: int) -> tuple[Column, Column]:
    """Width and height fitted to a longest edge of ``most``, by integer division, one at least."""
    longest = F.greatest(width, height)
    fit = lambda x: F.when(longest <= most, x).otherwise(F.greatest(F.lit(1), F.floor(x * most / longest))).cast("long")
    return fit(width), fit(height)


def fitted_edges(width: Column, height: Column, most_width: int, most_height: int, most_pixels: int = MOST_PIXELS) -> tuple[Column, Column]:
    """Width and height scaled down, never up, into a box, with a factor in double precision; one at least, null for no or too many pixels."""
    scale = F.least(F.lit(1.0), F.lit(float(most_width)) / F.nullif(width, F.lit(0)), F.lit(float(most_height)) / F.nullif(height, F.lit(0)))
    valid = (width > 0) & (height > 0) & (width.cast("decimal(20,0)") * height.cast("decimal(17,0)") <= most_pixels)
    fit = lambda x: F.when(valid, F.greatest(F.lit(1), F.floor(x.cast("double") * scale))).cast("long")
    return fit(width), fit(height)


def backoff_ms(attempt: Column, base_ms: int, most_ms: int) -> Column:
    """Delay before a retry, doubling with every attempt; without jitter."""
    return F.least(F.lit(float(base_ms)) * F.pow(F.lit(2.0), attempt - 1), F.lit(float(most_ms))).cast("long")
