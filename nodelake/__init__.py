"""Source-aware indexing and search on Spark."""

from .service import Repo

__all__ = ["Repo"]
