"""Analytics on image, frame and mask tables, written as Spark DataFrame jobs."""

from frameops.session import build_session

__all__ = ["build_session"]
