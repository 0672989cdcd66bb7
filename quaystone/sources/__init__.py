"""Readers of landed feeds, and the lake's writers and logs."""
