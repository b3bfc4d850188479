"""Product-footprint analytics as PySpark DataFrame operators."""

from weftline.session import build_session, persist_state, scratch_path

__all__ = ["build_session", "persist_state", "scratch_path"]
