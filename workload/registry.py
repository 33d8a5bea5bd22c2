"""Registers a query together with the SQL that checks it."""

from __future__ import annotations


def registry():
    queries: dict = {}
    sqls: dict = {}

    def query(name: str, sql: str | None = None):
        def register(fn):
            queries[name] = fn
            if sql is not None:
                sqls[name] = sql
            return fn

        return register

    return queries, sqls, query
