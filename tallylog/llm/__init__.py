"""Operators for preparing training data at scale.

Nothing outside this subpackage imports it; deleting the folder leaves the log engine whole.
"""
