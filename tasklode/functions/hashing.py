"""Hashes of text, ordered lists and canonical JSON."""

from __future__ import annotations

import hashlib
import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tasklode.functions.text import col

#: Keys that only identify a person.
IDENTIFIER_KEYS = frozenset(
    (
        "用户ID", "用户id", "用户编号", "用户标识", "账号ID", "账号id", "user_id", "userid", "userId", "account_id", "accountId",
        "customer_id", "customerId", "session_id", "sessionId",
    )
)


def ordered_hash(value: Column | str, position: Column | str, trailing: str = "") -> Column:
    """Aggregate: SHA-256 of the values by position, joined by newlines."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(col(position).alias("p"), col(value).cast("string").alias("v")))), lambda s: s["v"])
    return F.sha2(F.concat(F.array_join(items, "\n"), F.lit(trailing)), 256)


def salted(*parts: Column | str) -> Column:
    """SHA-256 of the parts, joined by a zero byte."""
    return F.sha2(F.concat_ws("\u0000", *(col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts)), 256)


def canonical(value: Any, compact: bool = True) -> str:
    """JSON with sorted keys; ``compact`` leaves out the spaces."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":") if compact else None)


def canonical_hash(value: Any, compact: bool = True) -> str:
    return hashlib.sha256(canonical(value, compact).encode()).hexdigest()


def canonical_json_hash(text: Column | str, compact: bool = True) -> Column:
    """SHA-256 of a JSON text in canonical form; null if it isn't JSON. Spark's to_json drops nulls and keeps
    the order of declaration, hence a vectorised function."""

    @F.pandas_udf("string")
    def hashed(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return canonical_hash(json.loads(t), compact) if t is not None else None
            except ValueError:
                return None

        return texts.map(one, na_action=None)

    return hashed(col(text))


def parsed_without(text: str, keys: frozenset[str]) -> Any:
    """The value of a JSON text; the keys are dropped from every object as it is read, the order of the others is kept."""
    return json.loads(text, object_pairs_hook=lambda pairs: dict(p for p in pairs if p[0] not in keys))


def sanitized_json(text: Column | str, keys: frozenset[str] = IDENTIFIER_KEYS) -> Column:
    """A JSON object without identifier keys, in its own order; other JSON as it is; null if it isn't JSON."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                value = parsed_without(t, keys) if t is not None else None
            except ValueError:
                return None
            return json.dumps(value, ensure_ascii=False) if isinstance(value, dict) else t

        return texts.map(one, na_action=None)

    return clean(col(text))
