"""Intermediate tables in the folder that all executors share."""

from ..sources.store import delete, passing_tables, written

__all__ = ["delete", "passing_tables", "written"]
