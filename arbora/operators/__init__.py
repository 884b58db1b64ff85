"""Questions over the tables of a corpus."""

from .outline import summarize
from .reading import breadcrumbs, children, find_node, provenance, read_node
from .search import find, snippet
from .tables import extract_table, select_table, table_cells, wide

__all__ = ["breadcrumbs", "children", "extract_table", "find", "find_node", "provenance", "read_node", "select_table", "snippet", "summarize", "table_cells", "wide"]
