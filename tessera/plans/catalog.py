"""Registry of the retrieval queries."""

from tessera.plans import base, dimensions, neighbours, pruning, relational, scoring, sweeps


def queries():
    return dict(base.QUERIES)


def oracle_sql():
    return dict(base.SQL)


__all__ = ["dimensions", "neighbours", "oracle_sql", "pruning", "queries", "relational", "scoring", "sweeps"]
