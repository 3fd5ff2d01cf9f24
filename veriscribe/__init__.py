"""Scoring of lossy text transcription, and corpus preparation, as Spark plans."""
