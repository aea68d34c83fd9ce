"""Readers and writers: raw attempts, health series, transactions, run tables."""
