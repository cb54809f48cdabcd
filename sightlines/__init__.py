"""Search-visibility analytics as DataFrame operators on Spark."""
