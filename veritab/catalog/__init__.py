"""All registered queries, by operator family."""

from veritab.catalog.registry import ORACLES, QUERIES
from veritab.catalog import scalars, judging, rulebook, answering, worksheets, evidence, reporting  # noqa: F401  (registration)
