"""All registered queries and their oracle SQL, gathered from the plan modules."""

from __future__ import annotations

from . import extras, models, preparation, traffic


def _modules():
    return [traffic, preparation, extras, models]


def all_queries():
    out = {}
    for m in _modules():
        out.update(m.QUERIES)
    return out


def all_oracle_sql():
    out = {}
    for m in _modules():
        out.update(m.ORACLE)
    return out


def flagship(spark, sf_dir):
    return traffic.q_verdict(spark, sf_dir)
