"""runledger: Spark jobs over the logs, tables and requests of training runs."""

from runledger.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
