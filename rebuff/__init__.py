"""Friction-response analytics for behavioural event logs, expressed as Spark DataFrame operators."""

__version__ = "0.1.0"
