"""Example workload over the generated test tables."""


def load():
    """(queries, oracles) of all workload modules."""
    from . import audit_queries, history_queries, profile_queries, registry, rule_queries, store_queries  # noqa: F401

    return registry.QUERIES, registry.ORACLES
