"""Digest columns: hashes, lanes of a mergeable hash, fingerprint texts."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a usable fingerprint looks like.
EMPTY_FINGERPRINT = "EMPTY:0"
USABLE_RE = r"^(EMPTY:0|[0-9a-f]{8}.*:[0-9].*)$"

LANE_DIGITS = 15  # hex digits
LANE_BITS = 60
LIMB_BITS = 12  # summed as bigint: safe for more than 2e15 rows
LIMBS = 5
LANES = {"md5": 2, "sha256": 4, "xxhash64": 2}


def digest(text: Column, algo: str) -> Column:
    if algo == "md5":
        return F.md5(text)
    if algo == "sha256":
        return F.sha2(text, 256)
    raise ValueError(f"unknown algorithm {algo!r}")


def digest_sql(text: str, algo: str) -> str:
    if algo == "md5":
        return f"md5({text})"
    if algo == "sha256":
        return f"sha2({text}, 256)"
    raise ValueError(f"unknown algorithm {algo!r}")


def lane_sql(hex_digest: str, i: int) -> str:
    """The i-th 60-bit lane of a hex digest as bigint."""
    return f"cast(conv(substring({hex_digest}, {1 + LANE_DIGITS * i}, {LANE_DIGITS}), 16, 10) AS bigint)"


def type_seed(kinds: str, lane: int) -> int:
    """A number for the column types and the lane, to begin a value hash with."""
    return int.from_bytes(hashlib.sha256(f"{lane}:{kinds}".encode()).digest()[:8], "big", signed=True)


def column_lane_sql(columns: list[str], nulls: list[str], seed: int) -> str:
    """A 60-bit lane straight from column values, without a text: chained xxhash64. The chain skips
    nulls, so their places are hashed as bit masks of up to 60 columns each."""
    masks = []
    for start in range(0, len(nulls), LANE_BITS):
        bits = [f"if({c} IS NULL, {1 << i}L, 0L)" for i, c in enumerate(nulls[start:start + LANE_BITS])]
        masks.append(" | ".join(bits))
    return f"xxhash64({', '.join([f"cast('{seed}' AS bigint)", *masks, *columns])}) & {(1 << LANE_BITS) - 1}L"


def limb_sum_sql(lane: str, j: int) -> str:
    shifted = f"shiftright({lane}, {LIMB_BITS * j})" if j else lane
    return f"sum({shifted} & {(1 << LIMB_BITS) - 1}L)"


def lane_total_sql(limb_sums: list[str]) -> str:
    """Recompose the exact lane sum from its limb sums; 0 when there were no rows."""
    terms = [
        f"cast({part} AS decimal(20,0)) * cast({1 << (LIMB_BITS * j)}L AS decimal(16,0))"
        for j, part in enumerate(limb_sums)
    ]
    return f"coalesce(cast({' + '.join(terms)} AS decimal(38,0)), cast(0 AS decimal(38,0)))"


def render(hex_digest: Column, n: Column) -> Column:
    """``<hex>:<count>``, or ``EMPTY:0``."""
    return F.when(n == 0, F.lit(EMPTY_FINGERPRINT)).otherwise(
        F.concat_ws(":", hex_digest, n.cast("string"))
    )


def usable_fingerprint(c: Column) -> Column:
    """False for null as well: an absent fingerprint proves nothing."""
    return F.coalesce(c.rlike(USABLE_RE), F.lit(False))


def fingerprint_digest(c: Column) -> Column:
    return F.regexp_extract(c, r"^(.*):([0-9]+)$", 1)


def fingerprint_count(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^(.*):([0-9]+)$", 2), F.lit("")).try_cast("bigint")


def require_usable(c: Column, what: Column | str) -> Column:
    """The fingerprint itself, or a failed query: never compare what proves nothing."""
    label = what if isinstance(what, Column) else F.lit(what)
    message = F.concat(F.lit("unusable fingerprint of "), label, F.lit(": "), F.coalesce(c, F.lit("<none>")))
    return F.when(usable_fingerprint(c), c).otherwise(F.raise_error(message).cast("string"))
