"""Typed record tables with relations, expressed as Spark DataFrame plans."""

from recordloom.model import AttributeType, Collection, RecordTable
from recordloom.session import build_session, prepare

__all__ = ["AttributeType", "Collection", "RecordTable", "build_session", "prepare"]
