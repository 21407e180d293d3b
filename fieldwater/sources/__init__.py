"""Readers and writers: meter tables, cell tables, stage tables and models."""
