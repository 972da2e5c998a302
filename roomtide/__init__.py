"""Room-sensor telemetry on PySpark: messages to bronze, silver, KPIs and readings."""
