"""weftline: retrieval, code-corpus and conversation analytics as PySpark DataFrame transformations."""
