"""Column expressions: they stay inside the JVM unless stated otherwise."""
