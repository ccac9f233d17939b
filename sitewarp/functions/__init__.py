"""Column functions: everything here returns a JVM-side Column expression."""
