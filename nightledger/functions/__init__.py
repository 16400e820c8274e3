"""Column expressions: no UDFs, everything stays in the JVM."""
