"""Corpus operators: chat formatting, search, tokenisation, language model, decontamination, PII, dedup, licences, toxicity."""
