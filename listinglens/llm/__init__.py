"""Training-data operators: PII, licences, chat, packing, quality, language, near-dedup, grading, decontamination, toxicity."""
