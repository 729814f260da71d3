"""Versioned tables and scratch folders."""
