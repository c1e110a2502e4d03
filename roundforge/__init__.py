"""Review-photo quiz datasets on Spark: ingest, sample, join, score, screen, deduplicate, curate, shard and publish."""
