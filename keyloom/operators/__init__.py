"""Operators over keyed structures: functions from DataFrame to DataFrame that run over all keys at once."""
