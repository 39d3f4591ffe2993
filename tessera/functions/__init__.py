"""Column-expression helpers; all evaluate inside the JVM."""
