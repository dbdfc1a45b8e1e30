"""Column functions on bytes, sizes and numbers; all run in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

KIB, MIB = 1 << 10, 1 << 20
#: A stripe holds four data shares; six shares are stored.
DATA_SHARES, SHARES = 4, 6
#: Sizes of the stripe catalogue; fixed values.
CATALOG_HEADER, CATALOG_RECORD, BOOTSTRAP = 21, 240, 32


def utf8(text: str | Column) -> Column:
    return F.encode(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), "UTF-8")


def mark(text: str | Column) -> Column:
    """The 16 bytes of a text's MD5, which stand for it where texts are only held equal."""
    return F.unhex(F.md5(text))


def ranged(data: Column, offset: int | Column, length: int | Column) -> Column:
    """``length`` bytes from ``offset`` (from 0)."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    return F.substring(data, (at + 1).cast("int"), F.lit(length) if isinstance(length, int) else length.cast("int"))


def hmac_sha256(key: bytes, data: Column) -> Column:
    """Hex HMAC-SHA256 with a key of at most 64 bytes: two nested hashes over padded keys."""
    block = key.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, data), 256))), 256)


def ceil_div(a: Column, b: int) -> Column:
    return F.floor((a + (b - 1)) / b).cast("long")


def fixed_coded(n: Column) -> Column:
    """Stored bytes when every stripe of up to 1 MiB takes six whole shares."""
    return ceil_div(n, MIB) * (SHARES * (MIB // DATA_SHARES))


def variable_coded(n: Column) -> Column:
    """Stored bytes when the last stripe's shares are as short as its data allows."""
    full = F.floor(n / MIB).cast("long")
    return full * (SHARES * MIB // DATA_SHARES) + ceil_div(n - full * MIB, DATA_SHARES) * SHARES


def protected(n: Column) -> Column:
    """Data shares, the coded catalogue of stripes, and six bootstraps that describe the catalogue's own stripes."""
    catalog = F.when(n > 0, F.lit(CATALOG_HEADER) + ceil_div(n, MIB) * CATALOG_RECORD).otherwise(F.lit(CATALOG_HEADER)).cast("long")
    return variable_coded(n) + variable_coded(catalog) + (ceil_div(catalog, MIB) * CATALOG_RECORD + BOOTSTRAP) * SHARES


def modeled_metadata(stripes: Column, unique: Column, references: Column, files: Column, patches: Column) -> Column:
    """Charges of the older model, times one and a half, rounded up."""
    raw = stripes * 232 + unique * 36 + references * 8 + files * 8 + unique + patches * 4
    return ceil_div(raw * 3, 2)


def varint_length(n: Column) -> Column:
    """Bytes of an unsigned number in groups of seven bits."""
    out = F.lit(1)
    for k in range(1, 5):
        out = out + F.when(n >= (1 << (7 * k)), 1).otherwise(0)
    return out


def magnitude_bytes(n: Column) -> Column:
    """Bytes of a signed number's magnitude, one at least; the smallest long is no exception."""
    size = F.ceil(F.length(F.hex(F.abs(n.cast("decimal(38,0)")).cast("long"))) / 2)
    return F.when(n == -(1 << 63), 8).otherwise(F.greatest(F.lit(1), size)).cast("int")


def anchors(data: Column) -> Column:
    """Keys of up to 64 bytes at the head, the middle and the tail."""
    n = F.octet_length(data)
    start = lambda at: F.substring(F.sha2(ranged(data, at, 64), 256), 1, 16)
    middle = F.floor(F.greatest(n - 64, F.lit(0)) / 2)
    return F.array(start(F.lit(0)), start(middle), start(F.greatest(n - 64, F.lit(0))))


def joined(parts: Column) -> Column:
    """The binaries of an array as one, in time that is linear in their bytes."""
    return F.unhex(F.array_join(F.transform(parts, F.hex), ""))


def exponent_form(x: float, digits: int = 12) -> str:
    """A number with so many decimals and an exponent without padding."""
    mantissa, _, exponent = f"{x:.{digits}e}".partition("e")
    return f"{mantissa}e{int(exponent)}"


def exponent_text(x: Column, digits: int = 12) -> Column:
    """``exponent_form`` of a column, in Arrow batches: the JVM's formatter rounds the shortest spelling, not the number."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: exponent_form(v, digits))

    return run(x)


def in_ranges(code: Column, ranges: Sequence[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for low, high in ranges:
        out = out | code.between(low, high)
    return out


def finite(text: Column) -> Column:
    """The text as a finite double, or null."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def times(byte: Column, factor: int) -> Column:
    """A byte times 1 to 4 in the field of 256 elements with the polynomial 0x11d."""
    double = F.shiftleft(byte, 1).bitwiseXOR(F.when(byte >= 128, 0x11D).otherwise(0))
    if factor == 1:
        return byte
    if factor == 2:
        return double
    if factor == 3:
        return double.bitwiseXOR(byte)
    return times(double, 2)
