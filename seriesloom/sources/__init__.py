"""Readers of price files and of the panels derived from tables, and writers of reports."""
