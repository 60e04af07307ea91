"""Seeded draws as column expressions: a 32-bit hash of named seeds, a counter-based generator, and digits of a digest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Offset and prime of the 32-bit FNV-1a hash, and the step of the generator.
FNV_OFFSET, FNV_PRIME, STEP = 2_166_136_261, 16_777_619, 0x6D2B79F5
_MASK = 0xFFFFFFFF
#: Service times in milliseconds, one for each hundredth of draws, and the least and the number of those of other streams.
SERVICE_MS = (
    250, 300, 330, 360, 390, 410, 430, 445, 460, 470, 480, 490, 500, 510, 520, 530, 540, 550, 560, 570,
    580, 585, 590, 595, 600, 605, 610, 615, 620, 623, 625, 628, 630, 633, 635, 638, 640, 642, 644, 646,
    648, 650, 650, 650, 650, 650, 650, 650, 650, 650, 650, 650, 650, 650, 650, 650, 660, 670, 680, 690,
    700, 710, 720, 730, 740, 750, 760, 770, 780, 790, 800, 810, 820, 830, 840, 850, 860, 870, 880, 890,
    900, 910, 920, 930, 940, 945, 948, 949, 950, 950, 950, 980, 1010, 1040, 1080, 1120, 1200, 1300, 1500, 1500,
)
ROBUSTNESS_MS, STRESS_MS = (1500, 1501), (2000, 3001)
CORE, ROBUSTNESS, STRESS = "core", "robustness", "stress"


def _low(value: Column) -> Column:
    return value.bitwiseAND(F.lit(_MASK))


def _shift(value: Column, bits: int) -> Column:
    return F.shiftrightunsigned(value, bits)


def times32(a: Column, b: Column) -> Column:
    """The low 32 bits of a product of two unsigned 32-bit numbers, in halves so that 64 bits are never passed."""
    low = a * b.bitwiseAND(F.lit(0xFFFF))
    high = (a * _shift(b, 16)).bitwiseAND(F.lit(0xFFFF)) * 65_536
    return _low(low + high)


def seed_of(seed: Column, namespace: str) -> Column:
    """FNV-1a over the UTF-16 units of ``string:<seed>:<namespace>``: streams of different names are independent."""
    text = F.concat(F.lit("string:"), seed.cast("string"), F.lit(f":{namespace}"))
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(....)"), F.lit(1))
    start = F.lit(FNV_OFFSET).cast("long")
    return F.aggregate(units, start, lambda h, u: times32(h.bitwiseXOR(F.conv(u, 16, 10).cast("long")), F.lit(FNV_PRIME).cast("long")))


def draw32(seed: Column, nth: Column) -> Column:
    """Draw number ``nth``, from 1, of a stream as an unsigned 32-bit number. Any draw is had without those before it."""
    state = _low(seed + times32(_low(nth.cast("long")), F.lit(STEP).cast("long")))
    mixed = times32(state.bitwiseXOR(_shift(state, 15)), state.bitwiseOR(F.lit(1).cast("long")))
    more = _low(mixed + times32(mixed.bitwiseXOR(_shift(mixed, 7)), mixed.bitwiseOR(F.lit(61).cast("long"))))
    mixed = mixed.bitwiseXOR(more)
    return mixed.bitwiseXOR(_shift(mixed, 14))


def below(draw: Column, n: Column) -> Column:
    """A 32-bit draw as a whole number from 0 up to ``n``, less one: floor(draw / 2 ** 32 * n)."""
    return F.floor(draw.cast("double") / 4_294_967_296 * n).cast("long")


def mixed_radix(hex_digest: Column, radices: Sequence[int]) -> Column:
    """Digits of a digest of any length, least radix first: each is the rest of a division, and the next is drawn from the quotient.

    The number is held as an array of 16-bit digits and divided as on paper, so all bits of the digest count.
    """
    digits = F.transform(F.regexp_extract_all(hex_digest, F.lit("(....)"), F.lit(1)), lambda d: F.conv(d, 16, 10).cast("long"))
    empty = F.array().cast("array<bigint>")
    start = F.struct(empty.alias("drawn"), digits.alias("digits"))

    def divide(state: Column, radix: Column) -> Column:
        worked = F.aggregate(
            state["digits"], F.struct(empty.alias("quotient"), F.lit(0).cast("long").alias("rest")),
            lambda acc, d: F.struct(
                F.concat(acc["quotient"], F.array(F.floor((acc["rest"] * 65_536 + d) / radix).cast("long"))).alias("quotient"),
                ((acc["rest"] * 65_536 + d) % radix).alias("rest"),
            ),
        )
        return F.struct(F.concat(state["drawn"], F.array(worked["rest"])).alias("drawn"), worked["quotient"].alias("digits"))

    return F.aggregate(F.array(*(F.lit(r).cast("long") for r in radices)), start, divide)["drawn"]


def stream_class(is_stress: Column, draw: Column) -> Column:
    """The latency class of a stream: stress by its population, robustness for a tenth of all others by a 64-bit draw, else core."""
    return F.when(is_stress, STRESS).when(draw % 10 == 0, ROBUSTNESS).otherwise(CORE)


def service_ms(kind: Column, draw: Column) -> Column:
    """A service time by class from a 64-bit draw: the table's for core, even within bounds for the others."""
    table = F.array(*map(F.lit, SERVICE_MS))
    even = lambda bounds: (draw % bounds[1] + bounds[0]).cast("int")
    return F.when(kind == CORE, F.get(table, (draw % len(SERVICE_MS)).cast("int"))).when(kind == ROBUSTNESS, even(ROBUSTNESS_MS)).otherwise(even(STRESS_MS))
