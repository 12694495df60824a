"""All registered queries; importing the step modules fills the registry."""

from cohortlens.catalog import basics, composed, joins, shapes, aggregates, stored  # noqa: F401
from cohortlens.catalog.registry import REGISTRY  # noqa: F401
