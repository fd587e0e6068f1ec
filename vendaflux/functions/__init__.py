"""Column-level helpers: ``Column -> Column``, all built from Spark built-ins."""
