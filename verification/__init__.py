"""Registered queries on the given tables, with their SQL counterparts."""
