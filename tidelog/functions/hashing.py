"""The routing hash of keys and the shard that it gives, as expressions.

CRC-32C over the key padded with zero bytes to words of eight, then a multiply-xor finish in 64 bits. Spark has no
unsigned 64-bit type, so the hash is DECIMAL(20, 0).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the hashes: the reversed CRC-32C polynomial, the seed, the multiplier, and that of the map hash.
POLYNOMIAL = 0x82F63B78
SEED = 0x9E3779B97F4A7C15
MULTIPLIER = 0xFF51AFD7ED558CCD
MAP_MULTIPLIER = 0xC4CEB9FE1A85EC53


def crc_table() -> list[int]:
    out = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (POLYNOMIAL if byte & 1 else 0)
        out.append(byte)
    return out


def _finish(h: Column) -> Column:
    """x ^ x >> 33 for an unsigned number as DECIMAL(20, 0); by halves, as bit operations are signed."""
    two32 = F.lit(1 << 32).cast("decimal(20,0)")
    high, low = F.floor(h / two32).cast("bigint"), (h % two32).cast("bigint")
    mixed = low.bitwiseXOR(F.shiftrightunsigned(high, 1))
    return (high.cast("decimal(20,0)") * two32 + mixed.cast("decimal(20,0)")).cast("decimal(20,0)")


def routing_hash(key: Column) -> Column:
    """The unsigned 64-bit hash of a string or binary key."""
    digits = F.hex(key.cast("binary"))
    n = (F.octet_length(key) + 7).cast("int") / 8
    padded = F.rpad(digits, F.floor(n).cast("int") * 16, "0")
    table = F.array(*[F.lit(x).cast("bigint") for x in crc_table()])
    places = F.sequence(F.lit(1), F.length(padded), F.lit(2))

    def step(crc: Column, at: Column) -> Column:
        byte = F.conv(F.substring(padded, at, F.lit(2)), 16, 10).cast("bigint")
        return F.shiftrightunsigned(crc, 8).bitwiseXOR(F.element_at(table, (crc.bitwiseXOR(byte).bitwiseAND(F.lit(255).cast("bigint")) + 1).cast("int")))

    crc = F.aggregate(places, F.lit(SEED & 0xFFFFFFFF).cast("bigint"), step).cast("decimal(20,0)")
    start = F.when(F.octet_length(key) == 0, _finish(F.lit(str(SEED)).cast("decimal(20,0)"))).otherwise(crc)
    return _finish(_times(start, MULTIPLIER))


def map_hash(routing: Column) -> Column:
    """The unsigned 64-bit hash of in-memory maps: a routing hash, best a column made before, multiplied and mixed once more."""
    return _finish(_times(routing, MAP_MULTIPLIER))


def _times(x: Column, factor: int) -> Column:
    """The product's low 64 bits, by halves of x: that of 64 by 64 bits has more than 38 digits."""
    two32, two64 = F.lit(1 << 32).cast("decimal(20,0)"), F.lit(str(1 << 64)).cast("decimal(20,0)")
    by = F.lit(str(factor)).cast("decimal(20,0)")
    low, high = (x % two32).cast("decimal(10,0)"), F.floor(x / two32).cast("decimal(10,0)")
    shifted = (((high * by) % two64).cast("decimal(20,0)") % two32).cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)")
    return (((low * by).cast("decimal(38,0)") + shifted.cast("decimal(38,0)")) % two64).cast("decimal(20,0)")


def shard(key: Column, n: int) -> Column:
    return (routing_hash(key) % F.lit(n).cast("decimal(20,0)")).cast("int")


def slab_class(size: Column) -> Column:
    """The smallest k with size <= 128 * 2**k, up to 6; null beyond."""
    out = F.when(size <= 128, F.lit(0))
    for k in range(1, 7):
        out = out.when(size <= 128 << k, F.lit(k))
    return out


def aligned(size: Column, to: int = 8) -> Column:
    """The size rounded up to a multiple."""
    return F.ceil(size / to).cast("bigint") * to


def pack_header(key_size: Column, value_size: Column) -> Column:
    return F.shiftleft(value_size.cast("bigint"), 32).bitwiseOR(key_size.cast("bigint"))


def unpack_header(header: Column) -> tuple[Column, Column]:
    return header.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")), F.shiftrightunsigned(header, 32)
