"""Column expressions evaluated in the JVM."""
