"""Invoice rate auditing on the Spark DataFrame API."""
