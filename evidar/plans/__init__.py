"""Named queries; importing the package registers them."""

from . import browse, chemistry, evaluation, evidence, grouping, marks, merging, methods, reading, reading_files, reports  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
