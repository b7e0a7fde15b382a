"""Journal ingestion as a stream."""
