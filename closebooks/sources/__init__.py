"""Readers and writers: CSV files, catalog tables, JDBC, sample views."""
