"""Small numeric and hashing functions as column expressions."""

from __future__ import annotations

import hashlib
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: milliseconds of the epoch from which unique ids count.
ID_EPOCH_MS = 1514764800000


def unique_id(machine: Column, timestamp_ms: Column, counter: Column) -> Column:
    """SN27: 12 bits of machine, 40 of milliseconds since the ids' epoch, 12 of counter; never negative."""
    high = F.shiftleft(machine.bitwiseAND(0xFFF).cast("long"), 52)
    middle = F.shiftleft((timestamp_ms - ID_EPOCH_MS).bitwiseAND((1 << 40) - 1), 12)
    return high.bitwiseOR(middle).bitwiseOR(counter.bitwiseAND(0xFFF).cast("long")).bitwiseAND((1 << 63) - 1)


def highest_bit(x: Column) -> Column:
    """SC05: position of the highest set bit of a positive number; null for zero, where it isn't defined."""
    return F.when(x > 0, (F.length(F.bin(x)) - 1).cast("int"))


def round_up_to_power2(x: Column) -> Column:
    return F.when(x <= 1, F.lit(1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), highest_bit(x - 1) + 1))


def div_round_up(a: Column, b: Column) -> Column:
    return F.call_function("div", a + b - 1, b)


def ip_number(ip: Column) -> Column:
    """SC06: a dotted address as a number."""
    part = F.split(ip, "\\.")
    return sum((F.shiftleft(part[i].cast("long"), 24 - 8 * i) for i in range(1, 4)), F.shiftleft(part[0].cast("long"), 24))


def random_text(seed: Column, length: int) -> Column:
    """SC07: letters and digits drawn by a hash of the seed."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    place = lambda i: (F.floor(drawn(0, seed, i) * len(letters)) + 1).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.substr(F.lit(letters), place(i), F.lit(1))), "")


def port_unique_id(ticks: Column, core: Column) -> Column:
    """SN26: a clock's ticks above 8 bits of core."""
    return F.shiftleft(ticks.cast("long"), 8).bitwiseOR(core.cast("long"))


def splitmix64(seed: int, n: Column) -> Column:
    """SC04: the n-th draw (from 1) of the 64-bit generator with this seed, as an unsigned decimal.

    State after n steps is seed + n * step, so a draw needs no draw before it.
    """
    # Fixed values of the generator.
    step, first, second = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

    def times(x: Column, k: int) -> Column:  # modulo 2**64, from 32-bit halves: no product overflows
        low, high = x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")), F.shiftrightunsigned(x, 32)
        k_low, k_high = k & 0xFFFFFFFF, k >> 32
        product = lambda a, b: (a.cast("decimal(20,0)") * F.lit(Decimal(b)).cast("decimal(20,0)")).cast("decimal(38,0)")
        cross = (product(low, k_high) + product(high, k_low)) % F.lit(Decimal(1 << 32)).cast("decimal(38,0)")
        return product(low, k_low) + cross * F.lit(Decimal(1 << 32)).cast("decimal(38,0)")

    mixed = lambda z, bits: z.bitwiseXOR(F.shiftrightunsigned(z, bits))
    state = (n.cast("decimal(20,0)") * F.lit(Decimal(step)).cast("decimal(20,0)")).cast("decimal(38,0)") + F.lit(Decimal(seed)).cast("decimal(38,0)")
    z = _with(_wrapped(state), lambda z: mixed(z, 30))
    z = _with(_with(z, lambda z: _wrapped(times(z, first))), lambda z: mixed(z, 27))
    z = _with(_with(z, lambda z: _wrapped(times(z, second))), lambda z: mixed(z, 31))
    return _with(z, lambda z: F.when(z < 0, z.cast("decimal(20,0)") + F.lit(Decimal(1 << 64)).cast("decimal(20,0)")).otherwise(z.cast("decimal(20,0)")))


def _with(x: Column, f) -> Column:
    """f(x), where x is computed once however often f uses it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _wrapped(x: Column) -> Column:
    """A non-negative decimal modulo 2**64 as the signed long with its bits."""
    whole, half = (F.lit(Decimal(1 << bits)).cast("decimal(38,0)") for bits in (64, 63))
    return _with(x % whole, lambda low: F.when(low >= half, low - whole).otherwise(low).cast("long"))


def shifted(time: Column, offset: Column) -> Column:
    """SC08: a clock's reading on another clock."""
    return time + offset


def vector_add(a: Column, b: Column) -> Column:
    """SC09."""
    return F.zip_with(a, b, lambda x, y: x + y)


def stream_scale(a: Column, k: Column) -> Column:
    """SC11."""
    return F.transform(a, lambda x: x * k)


def stream_triad(a: Column, b: Column, k: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y * k)


def _signature(message: Column, secret: str) -> Column:
    """HS256 of a message, as URL-safe base64. The keyed hash is two SHA-256 of padded keys, all in the JVM."""
    key = secret.encode() if len(secret.encode()) <= 64 else hashlib.sha256(secret.encode()).digest()
    key = key.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)
    first = F.unhex(F.sha2(F.concat(F.lit(bytearray(inner)), message.cast("binary")), 256))
    return _url64(F.unhex(F.sha2(F.concat(F.lit(bytearray(outer)), first), 256)))


def signed_token(user_id: Column, username: Column, timestamp: Column, secret: str, ttl: str = "3600") -> Column:
    """SN24: a login's claims and their HS256 signature."""
    claims = F.to_json(F.struct(timestamp.cast("string").alias("timestamp"), F.lit(ttl).alias("ttl"), user_id.cast("string").alias("user_id"), username.alias("username")))
    message = F.concat_ws(".", _url64(F.lit('{"alg":"HS256","typ":"JWT"}').cast("binary")), _url64(claims.cast("binary")))
    return F.concat_ws(".", message, _signature(message, secret))


def token_claims(token: Column, secret: str) -> Column:
    """FE02: the claims of a token as JSON, or null where it isn't signed with the secret."""
    parts = F.split(token, "\\.")
    message = F.concat_ws(".", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))
    claims = F.translate(F.get(parts, F.lit(1)), "-_", "+/")
    padded = F.rpad(claims, F.call_function("div", F.length(claims) + 3, F.lit(4)).cast("int") * 4, F.lit("="))
    return F.when((F.size(parts) == 3) & (F.get(parts, F.lit(2)) == _signature(message, secret)), F.unbase64(padded).cast("string"))


def drawn(seed: int, *of: Column) -> Column:
    """A number from [0, 1) drawn by a hash of the columns: the same whenever and wherever it's drawn again."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in of]).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def _url64(raw: Column) -> Column:
    return F.rtrim(F.translate(F.base64(raw), "+/=\r\n", "-_ "))
