"""Loan-tape analytics as Spark DataFrame operators."""
