"""Journals, catalogs, partitions and tuple spaces as tables."""
