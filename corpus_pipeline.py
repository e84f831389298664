"""The corpus pipeline of ``quirion.llm.pipeline``, where the driver looks for it."""

from quirion.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
