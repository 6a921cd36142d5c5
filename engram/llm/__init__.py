"""Operators for preparing large text corpora: one module per operator.

``engram.llm.queries`` lists the driver's queries; nothing outside this
subpackage imports it.
"""
