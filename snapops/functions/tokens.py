"""Ring tokens as decimal text.

Tokens run from -2^63 to 2^127. The upper end has 39 digits, one more than the widest
decimal, so arithmetic works on two base-10^20 limbs and ordering on a fixed-width key.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First token and range of the two partitioners.
MURMUR3 = "murmur3"
RANDOM = "random"
MURMUR3_MIN = -(2**63)
MURMUR3_RANGE = 2**64
RANDOM_RANGE = 2**127

WIDTH = 40
LIMB_DIGITS = 20
LIMB = 10**LIMB_DIGITS
WIDE = "decimal(38,0)"


def _big(value: int) -> Column:
    return F.lit(str(value)).cast(WIDE)


def _floor_div(a: Column, b: Column) -> Column:
    """Integer quotient of non-negative decimals (``div`` would narrow to bigint)."""
    return ((a - a % b) / b).cast(WIDE)


def _digits(token: Column) -> Column:
    return F.lpad(F.ltrim(token, F.lit("+-")), WIDTH, "0")


def is_negative(token: Column) -> Column:
    return token.startswith("-")


def sort_key(token: Column) -> Column:
    """Text whose order is the numeric order of the tokens."""
    digits = _digits(token)
    return F.when(
        is_negative(token),
        F.concat(F.lit("0"), F.translate(digits, "0123456789", "9876543210")),
    ).otherwise(F.concat(F.lit("1"), digits))


def token_of(key: Column) -> Column:
    """Inverse of :func:`sort_key`."""
    body = F.substring(key, 2, WIDTH)
    negative = F.translate(body, "0123456789", "9876543210")

    def plain(digits: Column) -> Column:
        short = F.ltrim(digits, F.lit("0"))
        return F.when(short == "", "0").otherwise(short)

    return F.when(key.startswith("0"), F.concat(F.lit("-"), plain(negative))).otherwise(plain(body))


def limbs(token: Column) -> tuple[Column, Column]:
    """Signed (high, low) with ``token = high * 10^20 + low``."""
    digits = _digits(token)
    sign = F.when(is_negative(token), F.lit(-1)).otherwise(F.lit(1)).cast("decimal(1,0)")
    high = F.substring(digits, 1, LIMB_DIGITS).cast("decimal(20,0)")
    low = F.substring(digits, LIMB_DIGITS + 1, LIMB_DIGITS).cast("decimal(20,0)")
    return (high * sign).cast("decimal(21,0)"), (low * sign).cast("decimal(21,0)")


def nearer_is_lower(token: Column, lower: Column, higher: Column) -> Column:
    """True when ``token - lower < higher - token``; a tie goes to the higher token."""
    (th, tl), (lh, ll), (hh, hl) = limbs(token), limbs(lower), limbs(higher)
    # sign of (higher - token) - (token - lower), kept per limb so that nothing overflows
    high = (hh + lh - th - th).cast("decimal(25,0)")
    low = (hl + ll - tl - tl).cast("decimal(25,0)")
    small = (high.cast("decimal(3,0)") * F.lit(str(LIMB)).cast("decimal(21,0)")).cast("decimal(30,0)") + low
    return F.when(F.abs(high) > 8, high > 0).otherwise(small > 0)


def next_token(token: Column) -> Column:
    """``token + 1``."""
    high, low = limbs(token)
    one = F.lit(1).cast("decimal(1,0)")
    carried = low + one == F.lit(str(LIMB)).cast("decimal(22,0)")
    new_high = F.when(carried, high + one).otherwise(high)
    new_low = F.when(carried, F.lit(0)).otherwise(low + one)
    positive = F.when(
        new_high > 0,
        F.concat(new_high.cast("string"), F.lpad(new_low.cast("string"), LIMB_DIGITS, "0")),
    ).otherwise(new_low.cast("string"))
    small = (token.try_cast(WIDE) + one).cast("string")
    return F.when(is_negative(token), small).otherwise(positive)


def slot_token(size: Column, position: Column, offset: Column, partitioner: str = RANDOM) -> Column:
    """``floor(range / size) * position + offset + first token``; null for bad arguments."""
    size, position, offset = (c.cast("decimal(10,0)") for c in (size, position, offset))
    valid = (size > 0) & (position >= 0) & (offset >= 0)
    size = F.when(valid, size)
    if partitioner == MURMUR3:
        stride = _floor_div(_big(MURMUR3_RANGE), size).cast("decimal(20,0)")
        return (stride * position + offset + _big(MURMUR3_MIN)).cast(WIDE).cast("string")
    high, low = divmod(RANDOM_RANGE, LIMB)
    stride_high = _floor_div(_big(high), size).cast("decimal(20,0)")
    rest = (_big(high) % size).cast("decimal(10,0)")
    scaled = (rest * F.lit(str(LIMB)).cast("decimal(21,0)")).cast(WIDE) + _big(low)
    stride_low = _floor_div(scaled.cast(WIDE), size).cast("decimal(20,0)")
    sum_low = (stride_low * position + offset).cast(WIDE)
    out_low = (sum_low % _big(LIMB)).cast("decimal(20,0)")
    out_high = (stride_high * position + _floor_div(sum_low, _big(LIMB))).cast(WIDE)
    return F.when(
        out_high > 0,
        F.concat(out_high.cast("string"), F.lpad(out_low.cast("string"), LIMB_DIGITS, "0")),
    ).otherwise(out_low.cast("string"))
