"""A corpus clean-up: drop bad and toxic documents, keep one of each near-duplicate
group, redact secrets, pack what is left into sequences.
"""

from __future__ import annotations

from hitweave.llm.stages import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
