"""Training-data operators: archive audit, tokenising, extraction, chat
formatting, similarity joins, decontamination, classifiers, deduplication and
language-model scoring.  Nothing outside this subpackage imports it."""
