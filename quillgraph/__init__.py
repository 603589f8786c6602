"""Message, text and graph analytics on PySpark DataFrames."""

from quillgraph.session import build_session, durable

__all__ = ["build_session", "durable"]
