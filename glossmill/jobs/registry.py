"""The registered queries of the page and translation jobs and their oracle SQL."""

from __future__ import annotations

from glossmill.jobs.oracles import SQL
from glossmill.jobs.queries import QUERIES

__all__ = ["QUERIES", "SQL"]
