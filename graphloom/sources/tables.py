"""Readers of the tables, with declared columns so that a file of another
shape fails at load and not in the middle of a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Expected columns of each table of the graph and of its feeds.
COLUMNS = {
    "nodes": "id type name properties summary embedding repo_id file_path start_line end_line",
    "edges": "id source_id target_id type confidence created_by properties",
    "node_snapshots": "snapshot_no taken_at id type name properties repo_id file_path start_line end_line",
    "graph_meta": "repo_id snapshot",
    "source_files": "repo_id file_path language size_bytes n_lines content",
    "intent_anchors": "id node_id created_at",
    "intent_features": "workspace_id id domain_id parent_feature_id updated_at",
    "repo_states": "workspace_id repo_key last_parse_hash last_pushed_at observed_at loaded_at",
    "intent_release_events": "workspace_id seq request_hash loaded_at",
    "sync_runs": "workspace_id feed cut_at status",
    "documents": "doc_id text source n_chars",
    "mix_targets": "source weight max_repeats",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read one table; raise when a declared column is absent."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    missing = [c for c in COLUMNS.get(name, "").split() if c not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks {missing}")
    return df
