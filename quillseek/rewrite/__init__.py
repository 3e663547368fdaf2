"""Rewrites and analyses of syntax trees. All run on the driver, none starts a Spark job."""

from .chain import Chain
from .context import Context, map_nodes
from .shape import cleanup, invert, referenced_fields, remove_fields
from .fields import hierarchical, resolve_fields
from .includes import expand_includes
from .kinds import aggregation_tree, sort_terms
from .visitor import Visitor
from .validate import ValidationError, ValidationOptions, ValidationResult, check

__all__ = ["Visitor", "Chain", "Context", "ValidationError", "ValidationOptions", "ValidationResult", "aggregation_tree", "check", "cleanup", "expand_includes", "hierarchical", "invert", "map_nodes", "referenced_fields", "remove_fields", "resolve_fields", "sort_terms"]
