"""Imports every module that registers queries."""

from attesta.plans import answering, attribution, chunking, contexting, evidence, graphing, knowledge, operations, preparing, searching, sourcing  # noqa: F401
