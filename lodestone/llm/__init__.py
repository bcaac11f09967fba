"""Operators for preparing training text at scale.

Nothing outside this folder imports it; deleting it leaves the rest of the
library whole.
"""
