"""Signed tokens: keyed hashes, which the JVM functions lack, in Arrow batches."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def signature(secret: str, payload: str, digits: int = 64) -> str:
    return hmac.new(secret.encode(), payload.encode(), hashlib.sha256).hexdigest()[:digits]


def signed(secret: str, space: str, payload: Column, digits: int = 64) -> Column:
    """``payload.signature``; ``space`` keeps tokens of one purpose from serving another. Null stays null."""

    @F.pandas_udf("string")
    def sign(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else f"{v}.{signature(secret, f'{space}:{v}', digits)}")

    return sign(payload.cast("string"))


def verified(secret: str, space: str, token: Column, digits: int = 64) -> Column:
    """The payload of a token whose signature is right, else null; compared in constant time."""

    def check(token: str | None) -> str | None:
        payload, _, given = (token or "").rpartition(".")
        good = signature(secret, f"{space}:{payload}", digits)
        return payload if payload and hmac.compare_digest(good, given) else None

    @F.pandas_udf("string")
    def verify(values: pd.Series) -> pd.Series:
        return values.map(check)

    return verify(token)
