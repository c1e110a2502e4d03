"""Sinks: packs, canonical shards, manifests, content-addressed assets, uploads, clean-up."""
