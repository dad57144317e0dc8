"""Training-data operators: deduplication, language, formatting, search, mixing and tokenisation."""
