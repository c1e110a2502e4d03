"""Operators for preparing training data at scale.

Each module holds one operator with its own general interface; ``entry`` holds
the thin queries that the driver runs. Nothing outside this folder imports it.
"""
