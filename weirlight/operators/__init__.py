"""Operators over long-form streams: one row per point, (stream, pos, t, channels...)."""
