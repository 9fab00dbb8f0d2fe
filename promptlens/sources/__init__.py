"""Inputs: log files, messages, dimensions and telemetry derived from an event table."""
