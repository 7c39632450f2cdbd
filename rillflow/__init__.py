"""Signal ingestion and delivery analytics as DataFrame-to-DataFrame functions."""

from rillflow.session import build_session, require_utc

__all__ = ["build_session", "require_utc"]
__version__ = "0.1.0"
