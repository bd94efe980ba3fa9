"""The corpus pipeline: its stages in order, the SQL that gives its rows (none can), and the run of them all."""

from tessera.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
