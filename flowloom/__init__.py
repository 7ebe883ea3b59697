"""Trip-demand analytics as PySpark DataFrame functions."""
