"""Perceptual digests as hex texts: similarity, majority votes, and digests of frames and sound."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _half(digest: Column, start: int) -> Column:
    """Eight hex digits as a number."""
    return F.coalesce(F.conv(F.substring(digest, start, 8), 16, 10).cast("long"), F.lit(0))


def hash_similarity(a: Column, b: Column) -> Column:
    """Share of equal bits of two hex digests of 1 to 16 digits; 0 if one is null or empty, isn't hex, or their lengths differ."""
    fits = (F.length(a) == F.length(b)) & a.rlike("^[0-9A-Fa-f]{1,16}\\z") & b.rlike("^[0-9A-Fa-f]{1,16}\\z")
    apart = F.bit_count(_half(a, 1).bitwiseXOR(_half(b, 1))) + F.bit_count(_half(a, 9).bitwiseXOR(_half(b, 9)))
    return F.when(F.coalesce(fits, F.lit(False)), 1.0 - apart / (4.0 * F.length(a))).otherwise(0.0)


def digest_bits(digest: Column) -> Column:
    """A hex digest of 16 digits as a 64-bit number; null if it isn't one. To be made once a segment, before segments meet."""
    good = digest.rlike("^[0-9A-Fa-f]{16}\\z")
    return F.when(good, F.shiftleft(_half(digest, 1), 32).bitwiseOR(_half(digest, 9)))


def hex_digest(bits: Column) -> Column:
    """The 16 hex digits of a 64-bit number."""
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def sign_bits(v: Column) -> Column:
    """Which of the first 64 numbers are positive: the first number is the lowest bit of the upper half, the 33rd that of the lower one."""
    place = [32 + i if i < 32 else i - 32 for i in range(64)]
    one = [F.lit((1 << p) - (1 << 64 if p == 63 else 0)).cast("long") for p in place]
    bits = F.lit(0).cast("long")
    for i in range(64):
        bits = bits.bitwiseOR(F.when(v[i] > 0, one[i]).otherwise(F.lit(0).cast("long")))
    return bits


def majority_digest(df: DataFrame, group: list[str], digest: str) -> DataFrame:
    """`group` columns, `digest`, `n`: each of 64 bits is set if more than half of the group's digests have it. Null, empty and wrong ones don't vote; without votes the digest is empty.

    One sum per bit, so votes add up before the shuffle.
    """
    d = F.col(digest)
    good = F.coalesce(d.rlike("^[0-9A-Fa-f]{16}\\z"), F.lit(False))
    halves = df.select(*group, good.alias("_ok"), _half(d, 1).alias("_h"), _half(d, 9).alias("_l"))
    votes = [F.sum(F.when(F.col("_ok"), F.shiftright(c, i).bitwiseAND(F.lit(1)))).alias(f"{c}{i}") for c in ("_h", "_l") for i in range(32)]
    counted = halves.groupBy(*group).agg(F.count(F.when(F.col("_ok"), 1)).alias("n"), *votes)
    half = lambda c: F.lower(F.lpad(F.hex(sum(F.when(F.col(f"{c}{i}") * 2 > F.col("n"), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i in range(32))), 8, "0"))
    return counted.select(*group, F.when(F.col("n") > 0, F.concat(half("_h"), half("_l"))).otherwise("").alias("digest"), "n")


def rms(v: Column) -> Column:
    """Root of the mean square of an array; null if empty."""
    return F.when(F.size(v) > 0, F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / F.size(v)))


def zero_crossings(v: Column) -> Column:
    """Share of neighbours with different signs (zero is a sign of its own); 0 for fewer than two."""
    pairs = F.zip_with(F.slice(v, 1, F.size(v) - 1), F.slice(v, 2, F.size(v) - 1), lambda a, b: F.when(F.signum(a.cast("double")) != F.signum(b.cast("double")), 1.0).otherwise(0.0))
    return F.when(F.size(v) > 1, F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / (F.size(v) - 1)).otherwise(0.0)


def frame_digest(pixels: Column, height: int, width: int, grid: int = 8, least_spread: float = 4.0) -> Column:
    """Digest of a gray frame, an array of its values row by row: a bit per block of a grid, from the first block down, that tells whether the block's mean is above the mean of all
    blocks. Rows and columns beyond whole blocks don't count. Empty for near-uniform frames (population deviation of the blocks' means below `least_spread`), arrays of another size,
    frames smaller than the grid, and null."""
    high, wide = height // grid, width // grid
    if not high or not wide:
        return F.lit("")
    once = lambda value, then: F.transform(F.array(value), then)[0]  # noqa: E731  (an expression that is named, so that it is made once)
    line = lambda p, at: F.aggregate(F.slice(p, at + 1, F.lit(wide)), F.lit(0.0), lambda s, x: s + x.cast("double"))
    corner = lambda b: F.floor(b / grid).cast("int") * (high * width) + F.pmod(b, F.lit(grid)) * wide
    means = lambda p: F.transform(F.sequence(F.lit(0), F.lit(grid * grid - 1)), lambda b: sum((line(p, corner(b) + y * width) for y in range(high)), F.lit(0.0)) / (high * wide))
    mean = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x)) / (grid * grid)
    digit = lambda m, level, d: F.aggregate(F.slice(m, d * 4 + 1, F.lit(4)), F.lit(0), lambda s, x: s * 2 + (x > level).cast("int"))
    text = lambda m, level: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(grid * grid // 4 - 1)), lambda d: F.lower(F.hex(digit(m, level, d).cast("long")))), "")
    varied = lambda m, level: F.sqrt(mean(m, lambda x: (x - level) * (x - level))) >= least_spread
    digest = lambda p: once(means(p), lambda m: once(mean(m, lambda x: x), lambda level: F.when(varied(m, level), text(m, level)).otherwise("")))
    return once(pixels, lambda p: F.when(F.size(p) == height * width, digest(p)).otherwise(""))


#: Sound bands lie between these frequencies, in Hz; a piece has at least so many samples and so much energy.
LOWEST, HIGHEST, LEAST_SAMPLES, SILENCE = 60.0, 4000.0, 64, 1e-10


def band_table(n: int, rate: int, bands: int = 32) -> list[int]:
    """The first frequency bin of each sound band, and the end of the last, for pieces of n samples: a geometric row of bins, rounded; bands that would be empty are left out."""
    if n < LEAST_SAMPLES:
        return []
    per = rate / n
    first, last = max(1, int(LOWEST / per)), min(n // 2, int(min(HIGHEST, rate / 2 - per) / per))
    if last <= first:
        return []
    return sorted({round(first * (last / first) ** (k / bands)) for k in range(bands + 1)})


def sound_digests(pieces: np.ndarray, rate: int, bands: int = 32) -> list[str]:
    """Digest of each row of samples: which bands of `band_table` hold at least the mean share of the energy. Empty for what is too short or silent."""
    table = band_table(pieces.shape[1], rate, bands)
    if not table:
        return [""] * len(pieces)
    tapered = pieces * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(pieces.shape[1]) / (pieces.shape[1] - 1)))
    turned = np.fft.rfft(tapered, axis=1)
    power = turned.real**2 + turned.imag**2
    below = np.concatenate([np.zeros((len(power), 1)), np.cumsum(power, axis=1)], axis=1)  # energy below each bin
    in_band = np.diff(below[:, table], axis=1)
    whole = below[:, table[-1]] - below[:, table[0]]
    weights = 1 << np.arange(bands - 1, bands - 1 - in_band.shape[1], -1, dtype=np.int64)
    number = ((in_band * bands >= whole[:, None]) * weights).sum(axis=1)
    return [f"{b:0{bands // 4}x}" if e >= SILENCE else "" for b, e in zip(number.tolist(), whole)]


def sound_digest(samples: Column, rate: int) -> Column:
    """`sound_digests` of arrays of samples; empty for null and for arrays with a null in them."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for arrays in parts:
            out = pd.Series([""] * len(arrays), index=arrays.index, dtype=object)
            there = arrays.dropna()
            there = there[[not pd.isna(a).any() for a in there]] if len(there) else there
            for _, same in there.groupby(there.map(len)) if len(there) else []:
                out[same.index] = sound_digests(np.stack([np.asarray(a, "f8") for a in same]), rate)
            yield out

    return run(samples)
