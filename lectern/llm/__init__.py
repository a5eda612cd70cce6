"""Operations of a large training-data pipeline: deduplication, language, PII, encoding, search, sharding."""
