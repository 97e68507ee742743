"""Column expressions; all run in the JVM unless their docstring says otherwise."""
