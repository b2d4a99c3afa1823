"""folioflow: a PySpark engine for document catalogues and corpus preparation."""
