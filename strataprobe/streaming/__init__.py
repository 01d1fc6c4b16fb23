"""Profiles of tables that grow."""
