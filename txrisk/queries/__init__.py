"""Registered queries by part of the library; each module has QUERIES and ORACLES."""
