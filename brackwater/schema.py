"""Schema of the graph's nodes as they are stored, in DDL, which readers, createDataFrame and VersionedTable take."""

ENTITY = "id string, type string, name string, package string, project_id string, properties string, seq bigint"
