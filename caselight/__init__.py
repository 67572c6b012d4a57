"""Service-desk SLA analytics as Spark DataFrame operators."""
