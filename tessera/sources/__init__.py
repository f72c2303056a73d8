"""Readers and writers of the formats that the registry exchanges."""
