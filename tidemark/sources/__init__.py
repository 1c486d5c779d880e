"""Schemas, connectors, parsers and sinks."""
