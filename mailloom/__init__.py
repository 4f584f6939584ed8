"""mailloom: email and text analytics as PySpark DataFrame pipelines."""
