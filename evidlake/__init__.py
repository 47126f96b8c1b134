"""Digital-evidence analytics as Spark DataFrame operators."""
