"""Readers and writers of articles, runs and judgments."""
