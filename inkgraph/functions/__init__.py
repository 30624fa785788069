"""Column expressions: note parsing, text sets, rendering helpers. All are built-in Spark functions."""
