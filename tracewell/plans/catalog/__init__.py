"""Every registered query and, where SQL can state it, its oracle."""

from tracewell.plans.catalog import events, flows, operations, payments, privacy, retrieval

_TOPICS = (events, privacy, payments, retrieval, operations, flows)


def all_queries() -> dict:
    return {name: query for topic in _TOPICS for name, query in topic.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for topic in _TOPICS for name, sql in topic.ORACLES.items()}
