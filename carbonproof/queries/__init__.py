"""Registered queries, each beside the SQL that it must equal."""
