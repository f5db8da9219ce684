"""All queries of the engine by name, and equal SQL."""

from __future__ import annotations

import functools

from claimspark.plans import claims, lists, money, projects, stored
from claimspark.sources import views
from claimspark.sources.shared import sized

ALL = money.QUERIES | lists.QUERIES | claims.QUERIES | projects.QUERIES | stored.QUERIES


def _sized(query):
    """query with as many shuffle partitions as its largest table needs; counting it reads the file's footer."""

    @functools.wraps(query)
    def run(spark, sf):
        return query(sized(spark, views.table(spark, sf, "lineitem").count()), sf)

    return run


def queries():
    return {name: _sized(query) for name, (query, _) in ALL.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in ALL.items()}
