"""Operations of a training-data pipeline: language, quality, media, dedup, mixing, tokens."""
