"""Table, payload and file sources and sinks."""
