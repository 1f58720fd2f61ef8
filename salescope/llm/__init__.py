"""Operators for the preparation of training text at scale.

Ten operators, one module each, the helpers they share (``textbytes``,
``textmap``, ``components``, ``tables``) and their registered queries
(``queries``).  Nothing outside this package imports it.
"""
