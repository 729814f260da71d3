"""Drivers that tie operators to tables, and the catalogue of queries."""
