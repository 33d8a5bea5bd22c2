"""Registered queries over the test tables, each beside the SQL that checks it."""
