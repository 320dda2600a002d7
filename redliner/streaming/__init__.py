"""Structured Streaming jobs over intake, call, action and queue logs."""
