"""Table readers, release readers and sinks."""
