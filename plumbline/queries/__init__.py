"""All registered queries. Importing the package registers them."""

from plumbline.queries import catalog_checks, files, handovers, histories, profiles  # noqa: F401
from plumbline.queries.registry import ORACLE, QUERIES  # noqa: F401
