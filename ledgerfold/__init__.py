"""ledgerfold: a key-value store treated as data.

An ordered log of operations is folded into a keyed state table, and every
read, report and maintenance job over the store is a DataFrame transformation.
"""

__version__ = "0.1.0"
