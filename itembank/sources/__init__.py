"""Table readers, file sources and sinks."""
