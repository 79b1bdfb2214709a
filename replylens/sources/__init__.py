"""Readers, column selection and sinks."""
