"""Column functions: hashing, text cleaning, numeric helpers, vectors."""

from tessera.functions.hashing import hash_below, hash_int, hash_unit, poisson_weight, salted_sha
from tessera.functions.numeric import (
    clip,
    clipped_prob,
    half_even,
    logit,
    r6,
    sigmoid,
    smd_continuous,
    smd_level,
)
from tessera.functions.text import (
    MISSING,
    age_band,
    age_decade,
    canonical,
    checkbox_union,
    is_unsafe,
    label_map,
    mapped,
    normalise_code,
    or_missing,
    platform_from_id,
    platform_from_path,
    tri_boolean,
    half_year,
)
from tessera.functions.vectors import cosine, dot, l2_norm, normalised

__all__ = [n for n in dir() if not n.startswith("_")]
