"""The list screen's query as one plan: scan, filter, order, page, project."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.filters import filter_listings, summary
from ..operators.ranking import relevance_keys


def upcoming_near(listings: DataFrame, *, today, skip: int = 0, limit: int = 20, **query) -> DataFrame:
    """One page, in order of relevance, of the upcoming listings that fit; filters reach the scan."""
    hits = filter_listings(listings, today=today, upcoming=True, **query)
    return summary(hits.orderBy(*relevance_keys(today)).offset(skip).limit(limit))
