"""Readers and writers of landed files: TSV, CSV, workbooks, HTML, JSON, run history."""
