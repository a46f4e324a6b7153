"""Spark-native operators for flux-tower, satellite-pixel and tide records."""

from brackish.session import build_session, settle

__all__ = ["build_session", "settle"]
