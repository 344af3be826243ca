"""Place and content-graph analytics as plain PySpark DataFrame functions."""
