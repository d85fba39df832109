"""Readers and writers of the tables that runs exchange."""
