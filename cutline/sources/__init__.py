"""Readers and writers of the file formats that surround a series."""
