"""All registered queries of the core and their SQL."""

from .operators import bundle, compare, coverage, differences, graph, ledger, matching, metrics, orphans, passages, quality, scalars, search, segments, sequence
from .sources import archives, files
from .streaming import quality as streamed

MODULES = [orphans, differences, quality, compare, search, matching, coverage, passages, metrics, sequence, ledger, segments, graph, bundle, scalars, files, archives, streamed]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}
