"""Registered queries: each applies operators to the driver's tables and carries the SQL that checks it."""
