"""Operations of a training-data pipeline over whole text corpora; nothing else in the library imports this subpackage."""
