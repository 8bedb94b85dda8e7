"""The registered queries of the reference's operators, family by family."""

from __future__ import annotations

from listinglens.plans import modelling, parsing, pipelines, relational, retrieval

FAMILIES = [parsing, relational, retrieval, modelling, pipelines]


def queries() -> dict:
    return {name: run for family in FAMILIES for name, run in family.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for family in FAMILIES for name, sql in family.ORACLES.items()}
