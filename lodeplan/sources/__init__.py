"""Readers, writers and the shared folder where lineage is cut."""
