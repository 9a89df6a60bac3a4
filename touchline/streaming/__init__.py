"""Part of touchline: streaming."""
