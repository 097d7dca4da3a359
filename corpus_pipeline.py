"""From raw documents to packed training sequences, stage by stage.

The stages are in the subpackage of the training-data operators.
"""

from stridefold.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
