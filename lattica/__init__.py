"""lattica: ordered-collection analytics, corpus processing and vector retrieval as PySpark plans."""
