"""trenchline: excavation-permit analytics as Spark DataFrame jobs.

Every public operator is a function ``(DataFrame, ...) -> DataFrame`` that
only declares a plan; nothing is collected unless the function name says so
(``enforce_*``, ``commit_*``).  Clock-dependent behaviour takes explicit
``as_of`` / ``now`` arguments.
"""

from trenchline.schema import PERMIT_COLUMNS, PERMIT_SCHEMA  # noqa: F401

__all__ = ["PERMIT_COLUMNS", "PERMIT_SCHEMA"]
