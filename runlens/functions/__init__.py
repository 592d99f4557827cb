"""Column expressions. Everything here returns a ``pyspark.sql.Column`` (JVM-side, codegen'd)."""
