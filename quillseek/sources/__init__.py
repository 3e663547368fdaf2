"""Where fields come from: schemas, aliases, computed fields and relations."""

from .catalog import FieldCatalog, FieldRef, Relation

__all__ = ["FieldCatalog", "FieldRef", "Relation"]
