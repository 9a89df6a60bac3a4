"""Part of touchline: functions."""
