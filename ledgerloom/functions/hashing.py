"""Keyed hashes and uniforms: the only random choices of the engine, independent of row order."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(purpose: str, seed: int) -> bytes:
    return hashlib.blake2b(f"{purpose}|{seed}".encode(), digest_size=32).digest()


def keyed_hex(purpose: str, seed: int, digits: int = 16) -> Callable[[Column], Column]:
    """Hex digits of a keyed BLAKE2b."""
    key = hash_key(purpose, seed)

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else hashlib.blake2b(v.encode(), digest_size=digits // 2, key=key).hexdigest())

    return run


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64 (public algorithm)."""
    with np.errstate(over="ignore"):
        z = x + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def keyed_uniform(purpose: str, seed: int, stream: str) -> Callable[[Column], Column]:
    """A number in [0, 1) for each string, independent between streams."""
    key, salt = hash_key(purpose, seed), np.uint64(int.from_bytes(hashlib.blake2b(stream.encode(), digest_size=8).digest(), "little"))

    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        h = np.array([int.from_bytes(hashlib.blake2b((v or "").encode(), digest_size=8, key=key).digest(), "little") for v in values], dtype=np.uint64)
        return pd.Series((mixed(h ^ salt) >> np.uint64(11)).astype(np.float64) / 2.0**53)

    return run


def choose(uniform: Column, options: list[str], weights: list[float]) -> Column:
    """Inverse-CDF draw; stays in Catalyst."""
    if any(w < 0 for w in weights) or sum(weights) <= 0:
        raise ValueError("weights must not be negative and must have a positive sum")
    bounds, at = [], 0.0
    for w in weights:
        at += w / sum(weights)
        bounds.append(at)
    found = F.lit(options[-1])
    for option, bound in reversed(list(zip(options[:-1], bounds[:-1]))):
        found = F.when(uniform < bound, option).otherwise(found)
    return found


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution function."""
    from statistics import NormalDist

    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        inverse = NormalDist().inv_cdf
        return values.map(lambda v: inverse(min(max(v, 1e-12), 1 - 1e-12)))

    return run(p)


def group_key(variable: str | None = None, public: str | None = None, environ: dict[str, str] | None = None) -> tuple[str, dict[str, str]]:
    """The key of a group draw and what may be recorded of it: where it comes from and its SHA-256, never the key.

    A secret key stands in the environment as 64 lower-case hex digits; otherwise ``public`` is used as it is.
    """
    import os
    import re

    if (variable is None) == (public is None):
        raise ValueError("name either an environment variable or a public key")
    key = public if variable is None else (os.environ if environ is None else environ).get(variable, "")
    if variable is not None and not re.fullmatch("[0-9a-f]{64}", key):
        raise ValueError(f"{variable} does not hold 64 lower-case hex digits")
    return key, {"source": "public" if variable is None else "environment", "sha256": hashlib.sha256(key.encode()).hexdigest()}
