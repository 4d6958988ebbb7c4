"""Evidence bases and audit analytics as Spark DataFrame operators."""
