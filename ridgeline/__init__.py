"""Daily and panel time-series analytics as lazy Spark DataFrame transforms."""

from ridgeline.panel import Panel

__all__ = ["Panel"]
