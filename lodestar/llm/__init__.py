"""Training-data operators: quality, deduplication, mixing, language-model scoring, decontamination, toxicity."""
