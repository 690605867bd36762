"""All queries of the core, by name."""

from . import delivery, problems, reference

QUERIES = {**problems.QUERIES, **reference.QUERIES, **delivery.QUERIES}
ORACLE_SQL = {**problems.ORACLE_SQL, **reference.ORACLE_SQL, **delivery.ORACLE_SQL}
