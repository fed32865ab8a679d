"""Column helpers: plain functions from Column to Column."""
