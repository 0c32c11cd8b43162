"""Queries: operators composed over the driver tables, and SQL that gives the same rows."""
