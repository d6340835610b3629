"""Training-data operators: each module holds one operator with its own interface.

``queries`` registers the thin ``opN_<name>`` queries and ``oracle`` their SQL.
Nothing outside this package imports it.
"""
