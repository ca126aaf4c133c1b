"""Evidence-based order, return and refund ledger analytics as plain Spark DataFrame functions."""
