"""Landing-folder ingest as a structured stream."""
