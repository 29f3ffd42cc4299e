"""Registered queries with their SQL, one module a family of operators."""
