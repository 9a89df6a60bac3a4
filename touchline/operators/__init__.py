"""Part of touchline: operators."""
