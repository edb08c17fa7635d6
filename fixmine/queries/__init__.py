"""Registered queries: each applies one operator to a whole table, with SQL that gives the same rows."""
