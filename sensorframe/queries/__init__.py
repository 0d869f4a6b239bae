"""Registered queries: each runs over whole given tables and, where SQL can say it, has an SQL twin."""

from sensorframe.queries import registry
from sensorframe.queries import (  # noqa: F401  (registration)
    alignment,
    cloud,
    columns,
    evaluation,
    geometry,
    release,
    sequences,
    streams,
    wrench,
)

QUERIES = registry.QUERIES
SQL = registry.SQL
