"""Training-data operators: one module per operator, registered by :mod:`symgrid.llm.registry`.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
