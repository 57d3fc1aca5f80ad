"""Operations on text, pages and media for training-data pipelines."""
