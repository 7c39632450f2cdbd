"""Payload scans and the normalisers that turn payloads into signals."""
