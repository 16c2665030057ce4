"""Training-data operators: ten self-contained modules, one operator each.

Nothing outside this subpackage imports it.
"""
