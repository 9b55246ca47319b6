"""The corpus pipeline: its stages, the function that applies them all, and the SQL of its rows (None: SQL cannot express it)."""

from sablefin.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
