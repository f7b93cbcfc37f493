"""From raw documents to packed training sequences: the stages of pageflow.llm.pipeline."""

from pageflow.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
