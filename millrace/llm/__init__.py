"""Training-data operators: decontamination, packing, extraction, cleaning, stores, dedup, licences, LM scoring, joins."""
