"""Table readers, named tables and sinks."""
