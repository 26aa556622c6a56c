"""paperloom: document analytics as Spark DataFrame and SQL jobs."""
