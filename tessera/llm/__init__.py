"""Training-data pipeline operators (deduplication, language, extraction, scans, sharding, BPE)."""
