"""Command-line entry points: python -m roomtide.jobs.<name>."""
