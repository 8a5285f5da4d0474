"""Column expressions; all of them stay on the JVM unless their name says otherwise."""
