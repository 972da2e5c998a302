"""Continuous layers: messages to bronze, bronze to silver."""
