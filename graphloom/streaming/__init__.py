"""Structured Streaming forms of the engine's incremental state.  The batch operators define the results; these keep them up to date."""
