"""Readers and writers of the field's file formats."""
