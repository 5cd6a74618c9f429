"""Every operator as a query over the given tables, with its SQL twin for a second engine."""

from catalog.registry import ORACLES, QUERIES  # noqa: F401
from catalog import analyse, cleaning, govern, integrate, landing, lineage, masking, quality, standardise, web  # noqa: F401,E402
