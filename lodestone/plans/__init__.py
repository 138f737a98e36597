"""All registered queries of the library's own operators."""

from lodestone.plans import cleaning_queries, registry_queries, retrieval_queries, structure_queries  # noqa: F401
from lodestone.plans.common import REGISTRY

QUERIES = {name: f for name, (f, _) in REGISTRY.items()}
ORACLES = {name: sql for name, (_, sql) in REGISTRY.items() if sql}
