"""Named queries over the given tables, each with the SQL that checks it where there is one."""

from vigilar.workload import relational, measures, features, reports, learned  # noqa: F401, I001
from vigilar.workload.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
