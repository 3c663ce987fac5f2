"""A PySpark engine for coordinate-based meta-analysis."""
