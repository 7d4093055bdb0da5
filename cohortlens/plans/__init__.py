"""Driver-table bindings of the operators; importing this package fills ``REGISTRY``."""

from cohortlens.plans import aggregates, cleaning, distributions, evaluation, io, models, study, survival  # noqa: F401
from cohortlens.plans.registry import REGISTRY, TABLES, QuerySpec, query, table  # noqa: F401
