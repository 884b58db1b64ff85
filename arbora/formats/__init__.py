"""Readers of the formats that need one: bytes in, a tree out. They run on the executors, a file at a time."""
