"""Operations that a training-data pipeline needs over very large text corpora."""
