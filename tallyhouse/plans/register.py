"""Where queries are registered: a name, a function of the warehouse, and a SQL twin over the same tables."""

from __future__ import annotations

from tallyhouse.plans.warehouse import Warehouse, twin

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(make):
        QUERIES[name] = lambda spark, sf_dir: make(Warehouse(spark, sf_dir))
        if sql:
            SQL[name] = twin(sql)
        return make

    return add
