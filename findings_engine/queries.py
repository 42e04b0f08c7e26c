"""The queries of the library's own operators and their SQL."""

from __future__ import annotations

from .plans import scale  # noqa: F401  its queries join the catalogue
from .plans.catalogue import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
