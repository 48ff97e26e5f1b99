"""The corpus pipeline (see riskloom.llm.stages): quality filter, exact dedup, near-dedup, decontamination, packing."""

from riskloom.llm.stages import STAGES, run

#: The model of the first stage, SimHash and the tokeniser are beyond SQL; the tests use brute force.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
