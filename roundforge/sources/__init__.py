"""Sources: JSON lines, packs, shards, files, HTTP."""
