"""Readers and writers of documents: parsed repositories, texts and vectors made
for their nodes, overrides of the linker, CSV, JSON lines, telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PLACE = "location struct<filePath: string, startLine: long, endLine: long>"
_TYPED = "struct<name: string, type: struct<text: string>>"
#: The parts of a parsed repository that the graph is made of.
PARSED = f"""id string, name string, path string, parserVersion string,
packages array<struct<id: string, name: string, version: string, path: string>>,
files array<struct<id: string, path: string, language: string, packageId: string>>,
functions array<struct<id: string, versionedId: string, name: string, kind: string, fileId: string, classId: string, isAsync: boolean, isExported: boolean, parameters: array<{_TYPED}>, returnType: struct<text: string>, complexity: long, {_PLACE}>>,
classes array<struct<id: string, name: string, fileId: string, isExported: boolean, {_PLACE}>>,
interfaces array<struct<id: string, name: string, fileId: string, isExported: boolean, {_PLACE}>>,
entrypoints array<struct<id: string, type: string, handlerId: string, {_PLACE}>>,
calls array<struct<id: string, callerId: string, calleeId: string, provenance: string, calleeExpression: string, {_PLACE}>>,
imports array<struct<id: string, sourceFileId: string, moduleSpecifier: string, targetFileId: string, importedNames: array<string>>>"""
#: Overrides of the linker.
MAPPER = "services array<struct<name: string, repo: string, aliases: array<string>, httpPrefix: string>>, sdkMappings array<struct<sdkPackage: string, sdkClass: string, sdkMethod: string, targetService: string>>, unresolvableServices array<string>"
VECTORS = "repoId string, provider string, model string, dimensions int, functions array<struct<functionId: string, versionedId: string, inputChecksum: string, embedding: array<double>>>"


def read_parsed(spark: SparkSession, path: str) -> DataFrame:
    """Parsed repositories, one JSON object a file, by the declared columns."""
    return spark.read.schema(PARSED).option("multiLine", True).json(path)


def part(parsed: DataFrame, name: str) -> DataFrame:
    """One list of the parsed repositories as a table, with repo_id."""
    return parsed.select(F.col("id").alias("repo_id"), F.explode(name).alias("x")).select("repo_id", "x.*")


def graph_tables(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and unresolved calls of parsed repositories; of equal ids
    the first by kind and text wins."""
    from ..operators.transform import call_edges, first_wins, unresolved_calls

    files = part(parsed, "files")
    by_file = files.select(F.col("id").alias("fileId"), F.col("path").alias("file_path")).distinct()
    rows = [files.select("repo_id", "id", F.lit("file").alias("type"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("path").alias("file_path"), F.lit(None).cast("long").alias("start_line"), F.lit("{}").alias("properties"))]
    rows.append(part(parsed, "packages").select("repo_id", "id", F.lit("package").alias("type"), "name", F.col("path").alias("file_path"), F.lit(None).cast("long").alias("start_line"), F.to_json(F.struct("version")).alias("properties")))
    edges = []
    for name, kind in (("functions", "function"), ("classes", "class"), ("interfaces", "interface")):
        p = part(parsed, name)
        extra = F.to_json(F.struct("isExported", *(["kind", "isAsync", "complexity"] if kind == "function" else [])))
        rows.append(p.join(by_file, "fileId", "left").select("repo_id", "id", F.lit(kind).alias("type"), "name", "file_path", F.col("location.startLine").alias("start_line"), extra.alias("properties")))
        held = p.where("coalesce(kind, '') <> 'method'") if kind == "function" else p
        edges.append(held.where("fileId is not null").select(F.col("fileId").alias("source_id"), F.col("id").alias("target_id"), F.lit(f"CONTAINS_{kind.upper()}").alias("type")))
        if kind == "function":
            edges.append(p.where("kind = 'method' and classId is not null").select(F.col("classId").alias("source_id"), F.col("id").alias("target_id"), F.lit("HAS_METHOD").alias("type")))
    edges.append(files.where("packageId is not null").select(F.col("packageId").alias("source_id"), F.col("id").alias("target_id"), F.lit("CONTAINS_FILE").alias("type")))
    edges.append(part(parsed, "entrypoints").where("handlerId is not null").select(F.col("id").alias("source_id"), F.col("handlerId").alias("target_id"), F.lit("HANDLES").alias("type")))
    edges.append(part(parsed, "imports").where("targetFileId is not null").select(F.col("sourceFileId").alias("source_id"), F.col("targetFileId").alias("target_id"), F.lit("IMPORTS").alias("type")))
    rows.append(part(parsed, "entrypoints").select("repo_id", "id", F.lit("entrypoint").alias("type"), F.col("id").alias("name"), F.col("location.filePath").alias("file_path"), F.col("location.startLine").alias("start_line"), F.to_json(F.struct(F.col("type").alias("entrypointType"))).alias("properties")))
    nodes = rows[0]
    for x in rows[1:]:
        nodes = nodes.unionByName(x)
    plain = edges[0]
    for x in edges[1:]:
        plain = plain.unionByName(x)
    plain = plain.select(F.concat("source_id", F.lit(":"), "type", F.lit(":"), "target_id").alias("id"), "source_id", "target_id", "type", F.lit(1.0).alias("confidence"))
    calls = part(parsed, "calls").select("id", F.col("callerId").alias("caller_id"), F.col("calleeId").alias("callee_id"), "provenance", F.col("calleeExpression").alias("callee_expression"))
    called = call_edges(calls).select(F.col("edge_id").alias("id"), "source_id", "target_id", F.lit("CALLS").alias("type"), "confidence")
    first = first_wins(nodes, "id", ["type", "name", "properties"], ["repo_id", "type", "name", "file_path", "start_line", "properties"])
    return first, plain.unionByName(called).dropDuplicates(["id"]), unresolved_calls(calls)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """id, version, checksum, value, model of vectors made for functions."""
    v = spark.read.schema(VECTORS).option("multiLine", True).json(path)
    return v.select("model", F.explode("functions").alias("f")).select(F.col("f.functionId").alias("id"), F.col("f.versionedId").alias("version"), F.col("f.inputChecksum").alias("checksum"), F.col("f.embedding").alias("value"), "model")


def read_mapper(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The linker's overrides as tables: services (service, repo_id; aliases
    too), mappings, unresolvable. Services without name or repository raise."""
    m = spark.read.schema(MAPPER).option("multiLine", True).json(path)
    s = m.select(F.explode("services").alias("s")).select("s.*")
    if not s.where("name is null or repo is null").isEmpty():
        raise ValueError("a service lacks its name or repository")
    names = F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("service")
    maps = m.select(F.explode("sdkMappings").alias("x")).select(F.col("x.sdkPackage").alias("sdk_package"), F.col("x.sdkClass").alias("sdk_class"), F.col("x.sdkMethod").alias("method"), F.col("x.targetService").alias("route"))
    return {"services": s.select(names, F.col("repo").alias("repo_id")), "mappings": maps, "unresolvable": m.select(F.explode("unresolvableServices").alias("service"))}


#: How a null is written in CSV, so that an empty text is not one.
_NULL = "(null)"


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with doubled quotes; a text with a NUL character raises."""
    texts = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    bad = F.lit(False)
    for c in texts:
        bad = bad | F.coalesce(F.contains(F.col(c), F.lit("\0")), F.lit(False))
    checked = [F.when(bad, F.raise_error(F.lit("a text holds a NUL character")).cast("string")).otherwise(F.col(c)).alias(c) if c in texts else F.col(c) for c in df.columns]
    df.select(*checked).write.option("header", True).option("quote", '"').option("escape", '"').option("nullValue", _NULL).mode("overwrite").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What write_csv wrote; an empty text and null stay apart."""
    return spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').option("nullValue", _NULL).option("multiLine", True).csv(path)


def append_lines(df: DataFrame, path: str) -> None:
    """Append records as JSON lines."""
    df.write.mode("append").json(path)


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines by a schema; lines that are no JSON are dropped."""
    return spark.read.schema(f"{schema}, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path).where("_bad is null").drop("_bad")


def since_cursor(rows: DataFrame, cursors: DataFrame, key: str, ts: str, start: str) -> DataFrame:
    """Rows after the cursor of their key (cursors: key, cursor), or from the
    start of the window where a key has none; the cursor is never moved up to
    the window's start."""
    floor = F.lit(start).cast(dict(rows.dtypes)[ts])
    j = rows.join(F.broadcast(cursors.select(key, "cursor")), key, "left")
    return j.where(F.when(F.col("cursor").isNull(), F.col(ts) >= floor).otherwise(F.col(ts) > F.col("cursor"))).drop("cursor")


#: Telemetry logs: resource, scope, records with typed attributes.
_ANY = "struct<stringValue: string, intValue: string, doubleValue: double, boolValue: boolean>"
OTLP = f"resourceLogs array<struct<resource: struct<attributes: array<struct<key: string, value: {_ANY}>>>, scopeLogs: array<struct<logRecords: array<struct<timeUnixNano: string, body: {_ANY}, attributes: array<struct<key: string, value: {_ANY}>>>>>>>>"


def read_otlp(spark: SparkSession, path: str) -> DataFrame:
    """session_id, nanos (0 when unknown), name, attrs (map of texts) of
    telemetry log records; records without a session are dropped."""
    raw = spark.read.schema(OTLP).option("multiLine", True).json(path)
    r = raw.select(F.explode("resourceLogs").alias("r")).select(F.explode("r.scopeLogs").alias("s")).select(F.explode("s.logRecords").alias("l")).select("l.*")
    text = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))
    attrs = F.map_from_entries(F.transform(F.col("attributes"), lambda a: F.struct(a["key"], text(a["value"]))))
    out = r.select(F.coalesce(F.col("timeUnixNano").try_cast("long"), F.lit(0)).alias("nanos"), F.col("body.stringValue").alias("name"), attrs.alias("attrs"))
    return out.select(F.col("attrs")["session.id"].alias("session_id"), "nanos", "name", "attrs").where("session_id is not null")
