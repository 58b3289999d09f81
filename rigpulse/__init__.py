"""Condition-monitoring analytics for heavy machines, written as Spark DataFrame jobs."""
