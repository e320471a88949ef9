"""Recoding of dirty tokens and categories."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelforge.functions.scalars import _col


def replace_tokens(c: Column | str, tokens: Mapping[str, Any], as_type: str = "string") -> Column:
    """Replace whole-value tokens, then cast; text that is no ``as_type`` becomes null."""
    value = _col(c).cast("string")
    out = value
    if tokens:
        chain = None
        for token, new in tokens.items():
            hit, text = value == F.lit(token), F.lit(str(new))
            chain = F.when(hit, text) if chain is None else chain.when(hit, text)
        out = chain.otherwise(value)
    return out if as_type == "string" else out.try_cast(as_type)


def ordinal(c: Column | str, codes: Mapping[str, int]) -> Column:
    """Dictionary recode; null for a value the dictionary lacks."""
    chain = None
    for value, code in codes.items():
        hit = _col(c) == F.lit(value)
        chain = F.when(hit, F.lit(code)) if chain is None else chain.when(hit, F.lit(code))
    return chain


def flag(c: Column | str, value: Any) -> Column:
    """1 where the column equals ``value``, else 0 (also for null)."""
    return F.when(_col(c) == F.lit(value), F.lit(1)).otherwise(F.lit(0))
