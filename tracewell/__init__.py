"""Security-event detection analytics as Spark DataFrame operators."""
