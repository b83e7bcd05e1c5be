"""Operators over grid tables: functions from DataFrame to DataFrame."""
