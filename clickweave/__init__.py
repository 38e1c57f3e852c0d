"""User-behaviour analytics over event tables and streams, as DataFrame and Structured Streaming jobs."""
