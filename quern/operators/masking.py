"""Masked-token training examples from hashed uniforms: seeded, independent of partitions and engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*key: Column) -> Column:
    """A number in [0, 1) from the md5 of the key's parts joined by ':'."""
    digest = F.md5(F.concat_ws(":", *[k.cast("string") for k in key]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(2**32))


def rate_between(low: float, high: float, seed: int, doc: Column) -> Column:
    """A rate of each document, even between ``low`` and ``high``."""
    return F.lit(low) + F.lit(high - low) * uniform(F.lit(seed), F.lit("rate"), doc)


SETTINGS = {"masked_substitution_rate": 0.15, "cloze_probability": 1.0, "random_probability": 0.0, "same_probability": 0.0}


def settings(config: dict) -> dict:
    """The masking part of a configuration: rate (a number, or a pair to draw from) and shares, checked."""
    unknown = set(config) - set(SETTINGS)
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    out = SETTINGS | config
    _checked(out["cloze_probability"], out["random_probability"], out["same_probability"])
    return out


def _checked(cloze: float, random: float, same: float) -> None:
    if abs(cloze + random + same - 1.0) > 1e-9 or min(cloze, random, same) < 0:
        raise ValueError("the shares of mask, random and same must add up to one")


def masked(
    ids: Column, doc: Column, seed: int, rate: Column, mask_id: int, pad_id: int, vocab: int, cloze: float = 1.0, random: float = 0.0, same: float = 0.0,
    call: int | None = None,
) -> Column:
    """struct(masked, cloze_mask, kinds): each id but the pad id is chosen with ``rate``; a chosen one becomes the
    mask id, a random id (neither mask nor pad) or stays, in the given shares.  kinds: 0 not chosen, 1 mask, 2 random, 3 same.

    One hash per place gives all its draws.  ``call`` tells repeated draws for the same rows apart.
    """
    _checked(cloze, random, same)
    key = [F.lit(seed), doc] + ([F.lit(call)] if call is not None else [])
    kept_out = sorted({x for x in (mask_id, pad_id) if 0 <= x < vocab})

    def one(x: Column, i: Column) -> Column:
        digest = F.md5(F.concat_ws(":", *[k.cast("string") for k in key], i.cast("string")))
        draw = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
        kind = (
            F.when((x == pad_id) | (draw(1) >= rate * F.lit(float(2**32))), F.lit(0))
            .when(draw(9) < cloze * 2**32, F.lit(1))
            .when(draw(9) < (cloze + random) * 2**32, F.lit(2))
            .otherwise(F.lit(3))
        )
        return F.struct(x.alias("x"), kind.alias("k"), (F.when(kind == 2, draw(17)) if random else F.lit(None).cast("long")).alias("d"))

    def new(z: Column) -> Column:
        # Spread over the ids that are left, then moved past those that are not to be drawn.
        drawn = F.floor(z["d"] / F.lit(float(2**32)) * (vocab - len(kept_out))).cast("int")
        for x in kept_out:
            drawn = F.when(drawn >= x, drawn + 1).otherwise(drawn)
        return F.when(z["k"] == 1, F.lit(mask_id)).when(z["k"] == 2, drawn).otherwise(z["x"])

    # The places are an element of an array of one, so that each is drawn once and used three times.
    places = F.transform(ids, one)
    return F.transform(F.array(places), lambda p: F.struct(
        F.transform(p, new).alias("masked"), F.transform(p, lambda z: z["k"] > 0).alias("cloze_mask"), F.transform(p, lambda z: z["k"]).alias("kinds")
    ))[0]


def masked_batch(flat: Column, batch: Column, seed: int, rate: Column, mask_id: int, pad_id: int, vocab: int, **shares: float) -> Column:
    """Masking of a packed batch: the same over its flat ids; its cumulative lengths are not touched."""
    return masked(flat, batch, seed, rate, mask_id, pad_id, vocab, **shares)


def curriculum(step: Column, total: int, final: int, start: float, end: float, base: float) -> Column:
    """Share of masked batches: linear from ``start`` to ``end``, then ``base``."""
    steps = max(1, total - final)
    return F.when(step >= steps, F.lit(base)).otherwise(F.lit(start) + step / F.lit(float(steps)) * F.lit(end - start))
