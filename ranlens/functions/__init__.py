"""Column expressions: everything stays inside the JVM and code generation."""
