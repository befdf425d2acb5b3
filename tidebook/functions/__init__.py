"""Column functions: all JVM-side expressions, no UDFs."""
