"""Streams of jobs and heartbeats."""
