"""Environmental telemetry analytics written as Spark DataFrame plans."""
