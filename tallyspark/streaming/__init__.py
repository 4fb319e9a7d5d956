"""Streaming counterparts: windowed counts with watermarks, and scores of games kept as points arrive."""
