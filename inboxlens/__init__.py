"""inboxlens: mail-audit analytics as Spark DataFrame operators.

Every public operator takes and returns DataFrames; the work runs as Spark
scans, joins, aggregations and windows so it scales with the message table.
"""

from inboxlens.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
