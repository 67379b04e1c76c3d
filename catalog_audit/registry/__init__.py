"""Every query by name, with the DuckDB statement that checks it where SQL can."""

from catalog_audit.registry import documented, formulas, ingest, measures, reports, streams  # noqa: F401
from catalog_audit.registry import published  # noqa: F401, I001  (puts together the statements of the others)
from catalog_audit.registry.base import ORACLES, QUERIES, fresh  # noqa: F401
