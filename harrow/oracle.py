"""SQL for the queries of the registry."""

from . import queries as catalogue
from . import registry


def oracle_sql() -> dict[str, str]:
    registry.load()
    return dict(catalogue.SQL)
