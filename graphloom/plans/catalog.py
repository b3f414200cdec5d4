"""All registries of the core, and the flagship query."""

from . import general_problems, graph_queries, ingest_queries, linker_queries, stream_queries, tool_queries, usage_queries

FLAGSHIP = "g43_package_dependency_rollup"
REGISTRIES = [m.REGISTRY for m in (general_problems, graph_queries, usage_queries, linker_queries, ingest_queries, tool_queries, stream_queries)]
