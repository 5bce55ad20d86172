"""Training-data operators: packing, decontamination, URL filters, licences,
near-duplicates, language models, personal data, WARC, language ID and media."""
