"""Star-schema column analytics as plain Spark plans."""
