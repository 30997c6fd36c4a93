"""The corpus pipeline: five stages from raw documents to a mix of sources, each written and read again as Parquet.

The stages are defined in ``tidemark.llm.pipeline``.
"""

from tidemark.llm.pipeline import STAGES, run

#: SQL expresses neither the models nor the links; tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
