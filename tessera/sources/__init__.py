"""Readers and writers of records, pairs, tasks, answers and results."""
