"""Readers and writers for recordings, logs, policies and reports."""
