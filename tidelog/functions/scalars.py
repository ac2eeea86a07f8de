"""Scalar functions, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def epoch_ms(ts: Column) -> Column:
    """A timestamp's epoch milliseconds, rounded down; a zoneless one is read in the session's time zone."""
    return F.unix_millis(ts.cast("timestamp"))


def signed32(x: Column) -> Column:
    """An unsigned 32-bit value in a long, as the signed value of the same bits."""
    return F.when(x >= 2**31, x - 2**32).otherwise(x)


def signed_crc32(value: Column) -> Column:
    """CRC-32 of bytes as a signed 32-bit value in a long; null for null."""
    return signed32(F.crc32(value))


def is_tombstone(value: Column) -> Column:
    """Zero-length bytes say that the key is deleted."""
    return F.octet_length(value) == 0


def is_expired(expires_ms: Column, now_ms: Column | int) -> Column:
    """-1 never expires; the boundary itself counts as expired."""
    return (expires_ms != -1) & (expires_ms <= now_ms)


def node_key(ip: Column, port: Column) -> Column:
    return F.concat_ws(":", ip, port.cast("string"))


def virtual_key(node: Column, replica: Column) -> Column:
    return F.concat(node, F.lit("-"), replica.cast("string"))


def get_or(map_: Column, key: Column, default) -> Column:
    """A map's value, or the default where the key is absent or the value null."""
    return F.coalesce(F.try_element_at(map_, key), F.lit(default))


def three_way(a: Column, b: Column) -> Column:
    """-1, 0 or 1."""
    return F.when(a < b, -1).when(a > b, 1).otherwise(0)


def majority(peers: Column | int) -> Column:
    """Votes that win, self included, among `peers` others: peers div 2 + 1."""
    return (F.lit(peers) / 2).cast("long") + 1 if isinstance(peers, int) else F.floor(peers / 2) + 1


def uniform_int(key: Column, low: int, high: int) -> Column:
    """A value in [low, high) that depends on the key only."""
    return (F.pmod(F.xxhash64(key), F.lit(high - low)) + low).cast("int")


def stripe(key: Column, stripes: int) -> Column:
    """The stripe of an integer key; negative keys have one as well."""
    return F.pmod(key, F.lit(stripes)).cast("int")


def hashed_stripe(key: Column, stripes: int) -> Column:
    """The stripe of a key of any type."""
    return F.pmod(F.xxhash64(key), F.lit(stripes)).cast("int")


def render_store(keys: Column, values: Column) -> Column:
    """KVStore[kv={k=v, ...}] of two arrays, in their order."""
    pairs = F.zip_with(keys, values, lambda k, v: F.concat(k.cast("string"), F.lit("="), v.cast("string")))
    return F.concat(F.lit("KVStore[kv={"), F.array_join(pairs, ", "), F.lit("}]"))


def _let(x: Column, body) -> Column:
    """body(x) with x computed once."""
    return F.transform(F.array(x), body)[0]


def _low32(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF))


def _times(x: Column, c: int) -> Column:
    """x * c modulo 2**32 in 16-bit halves, so no long overflows."""
    return _low32(x.bitwiseAND(F.lit(0xFFFF)) * F.lit(c) + (F.shiftright(x, 16) * F.lit(c)).bitwiseAND(F.lit(0xFFFF)) * F.lit(1 << 16))


def _rotate(x: Column, r: int) -> Column:
    return _low32(F.shiftleft(x, r)).bitwiseOR(F.shiftright(x, 32 - r))


#: Fixed values of MurmurHash3 x86 32-bit (public domain): block multipliers, step, final multipliers.
C1, C2, STEP, M1, M2 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35


def murmur3_32(text: Column, seed: int = 0) -> Column:
    """MurmurHash3 x86 32-bit of the UTF-8 bytes, as a signed value in a long; null for null."""

    def scrambled(k: Column) -> Column:
        return _let(_times(k, C1), lambda x: _let(_rotate(x, 15), lambda y: _times(y, C2)))

    def of(digits: Column) -> Column:
        n = F.floor(F.length(digits) / 2).cast("long")
        blocks = F.floor(n / 4).cast("long")
        pair = lambda i, j: F.substring(digits, (i * 8 + 2 * j + 1).cast("int"), F.lit(2))  # noqa: E731  byte j of block i in hex
        block = lambda i: F.conv(F.concat(*[pair(i, j) for j in (3, 2, 1, 0)]), 16, 10).cast("long")
        step = lambda h, i: _let(h.bitwiseXOR(scrambled(block(i))), lambda x: _low32(_rotate(x, 13) * 5 + STEP))
        every = F.when(blocks > 0, F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array().cast("array<bigint>"))
        body = F.aggregate(every, F.lit(seed).cast("long"), step)
        left = n - blocks * 4
        rest = F.when(left > 0, block(blocks)).otherwise(F.lit(0).cast("long"))  # bytes past the end are empty digits
        mixed = body.bitwiseXOR(F.when(left > 0, scrambled(rest)).otherwise(F.lit(0).cast("long"))).bitwiseXOR(n)
        mixed = _let(mixed, lambda x: _times(x.bitwiseXOR(F.shiftright(x, 16)), M1))
        mixed = _let(mixed, lambda x: _times(x.bitwiseXOR(F.shiftright(x, 13)), M2))
        return _let(mixed, lambda x: signed32(x.bitwiseXOR(F.shiftright(x, 16))))

    return F.when(text.isNotNull(), _let(F.hex(F.encode(text, "UTF-8")), of))
