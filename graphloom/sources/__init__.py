"""Readers and writers: graph files, datasets, sheets, answer files, traces and logs."""
