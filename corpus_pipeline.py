"""A corpus pipeline of five stages over documents."""

from __future__ import annotations

from rillwater.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
