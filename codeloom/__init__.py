"""codeloom: code-intelligence analytics as lazy PySpark DataFrame pipelines."""
