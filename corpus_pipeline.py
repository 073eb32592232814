"""The corpus pipeline's stages and run(), as the check and __spark_entry__ look for them."""

from flowscape.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
