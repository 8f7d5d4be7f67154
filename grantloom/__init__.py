"""Research-portfolio analytics as Spark DataFrame, SQL and MLlib jobs."""
