"""Column builders: every function takes and returns ``Column`` and stays in the JVM."""
