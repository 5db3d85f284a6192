"""Column-in, column-out helpers; all of them stay inside the JVM."""
