"""Operators over event tables and entity-month panels."""
