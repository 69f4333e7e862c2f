"""Registered queries, each with the SQL that it is compared with where SQL can express it."""
