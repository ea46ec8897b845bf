"""Operators of a training-data pipeline, each a Spark job over whole texts.

Nothing else in the library imports this subpackage.  ``queries`` registers one
``opN_<name>`` query per operator.
"""
