"""Helpers of the tests."""

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(value):
    """A value as both engines give it."""
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, bytearray | bytes):
        return bytes(value)
    if isinstance(value, list | tuple):
        return tuple(normal(v) for v in value)
    return value
