"""Statement, backup and file sources, and the export sink."""
