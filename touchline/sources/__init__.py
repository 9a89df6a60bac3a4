"""Part of touchline: sources."""
