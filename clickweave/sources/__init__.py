"""Event schema and event sources: files, Kafka, the raw lake and the adapter over the test tables."""
