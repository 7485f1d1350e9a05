"""Structured Streaming jobs: report validation and message intents."""
