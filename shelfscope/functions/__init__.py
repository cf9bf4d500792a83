"""Column functions; all are JVM expressions."""
