"""tarnwell: a PySpark engine for preparing and scoring text corpora."""
