"""Training-data operators: privacy, de-duplication, scoring, decontamination, encoding and archives."""
