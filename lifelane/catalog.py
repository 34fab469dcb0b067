"""The registered queries of the longitudinal operators and the SQL that checks them."""

from __future__ import annotations

from .queries import cleaning, coding, cohorts, histories, modelling, summaries

FLAGSHIP = "cohort_initiation"
_TOPICS = (cleaning, histories, coding, cohorts, summaries, modelling)


def queries() -> dict:
    return {name: f for topic in _TOPICS for name, f in topic.query.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s for topic in _TOPICS for name, s in topic.query.sql.items()}
