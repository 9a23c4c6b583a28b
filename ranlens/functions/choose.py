"""CASE expressions from a list of branches."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import Column, functions as F


def choose(branches: Iterable[tuple[Column, Any]], otherwise: Any) -> Column:
    """``CASE WHEN … THEN … ELSE otherwise END``; the first true branch wins. Without branches, ``otherwise``."""
    case: Any = F
    for condition, value in branches:
        case = case.when(condition, value)
    return case.otherwise(otherwise) if case is not F else F.lit(otherwise)
