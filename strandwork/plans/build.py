"""From a source tree to a graph: list, parse once, settle references by joins, merge, and add what needs the whole graph.

Facts are kept per file before any merge, so a refresh replaces the facts of changed files and everything after is the same plan
over the same kind of table: an incremental build equals a full one.
"""

from __future__ import annotations

import os
import sys

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandwork.graph import Graph
from strandwork.operators.merge import merge_edges, merge_nodes
from strandwork.operators.resolution import crossings, longest_directory, stitch
from strandwork.schema import id_column
from strandwork.session import materialize, ship_package
from strandwork.sources import configs, js_facts, python_facts
from strandwork.sources.listing import ScanOptions, scan
from strandwork.sources.python_facts import FACTS, MODEL_BASES, SOURCE_ID, TARGET_ID

MANIFEST = "path string, kind string, rank int, sha256 string, mtime double"
_COLUMNS = [x.split()[0] for x in FACTS.split(", ")]


def sources_table(spark: SparkSession, options: ScanOptions) -> tuple[DataFrame, list[tuple[str, str]], list[tuple[str, str, str, int]]]:
    """(path, kind, rank, content) of every listed file, read by the workers from the shared tree; the listing and its warnings."""
    files, warnings = scan(options)
    ship_package(spark)
    root = os.path.realpath(options.root)
    rows = [(p, k, i) for i, (p, k) in enumerate(files)]
    listed = spark.createDataFrame(rows, "path string, kind string, rank int")
    listed = listed.repartition(max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism)))

    def read(frames):
        for f in frames:
            content, mtime = [], []
            for p in f["path"]:
                full = os.path.join(root, p)
                try:
                    with open(full, "rb") as x:
                        text, time = x.read(), os.path.getmtime(full)
                except OSError:  # becomes a warning
                    text, time = None, 0.0
                content.append(text)
                mtime.append(time)
            yield f.assign(content=content, mtime=mtime)

    return listed.mapInPandas(read, "path string, kind string, rank int, content binary, mtime double"), files, warnings


def extract(sources: DataFrame, added=()) -> DataFrame:
    """Facts of the Python and JavaScript files of (path, kind, rank, content); each file is parsed once.

    ``added``: extractors of the caller, functions of a ``python_facts.File``, which run in the same pass over its tree.
    """
    ship_package(sources.sparkSession)

    def parse(frames):
        for f in frames:
            rows = []
            for path, kind, rank, content in zip(f["path"], f["kind"], f["rank"], f["content"]):
                content = None if content is None else bytes(content)
                rows += python_facts.file_facts(path, int(rank), content, added) if kind == "python" else js_facts.file_facts(path, int(rank), content)
            out = pd.DataFrame(rows, columns=_COLUMNS)
            for c in ("line_number", "certainty", "stage", "file", "n"):
                out[c] = out[c].astype("Int32")
            yield out

    return sources.where("kind in ('python', 'js')").select("path", "kind", "rank", "content").mapInPandas(parse, FACTS)


def resolved(facts: DataFrame) -> DataFrame:
    """Facts whose references to other files are settled; those that come to nothing are gone."""
    modules = facts.where("kind = 'node' and type = 'MODULE' and stage = 0").select(F.col("qualified_name").alias("m")).distinct()
    parts = F.split("m", r"\.")
    packages = modules.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))).alias("p")).distinct()
    classes = facts.where("kind = 'node' and type = 'CLASS' and stage = 1 and file_path is not null").groupBy(F.col("name").alias("c")).agg(F.max_by("qualified_name", F.struct("file", "n")).alias("found"))
    bases = facts.where("kind = 'base'").select("name").unionByName(facts.sparkSession.createDataFrame([(b,) for b in MODEL_BASES], "name string")).distinct().withColumnRenamed("name", "b")
    key = F.col("keys")[0]
    f = facts.where("kind <> 'base'").withColumn("k", key).withColumn("top", F.split("k", r"\.")[0])
    f = f.join(modules.withColumn("is_module", F.lit(True)), F.col("k") == F.col("m"), "left").drop("m")
    f = f.join(modules.select(F.col("m").alias("t"), F.lit(True).alias("is_top")), F.col("top") == F.col("t"), "left").drop("t")
    f = f.join(packages.withColumn("is_package", F.lit(True)), F.col("k") == F.col("p"), "left").drop("p")
    f = f.join(classes, F.col("k") == F.col("c"), "left").drop("c")
    model = f.where("ref = 'base'").select("file", "stage", "n", F.explode("keys").alias("b")).join(bases, "b", "left_semi").select("file", "stage", "n").distinct()
    f = f.where("ref is null or ref <> 'base'").unionByName(f.where("ref = 'base'").join(model, ["file", "stage", "n"], "left_semi"))
    f = f.where("ref is null or ref <> 'known class' or found is not null")
    standard = F.col("top").isin(*sorted(sys.stdlib_module_names))
    known = F.coalesce("is_module", "is_top", F.lit(False))
    is_import, is_relative, is_alias, is_class = (F.coalesce(F.col("ref") == r, F.lit(False)) for r in ("module", "relative", "alias", "class"))
    own = F.coalesce(F.col("is_module"), F.lit(False))
    certainty = F.when(is_import, F.when(standard | known, 3).otherwise(2)).when(is_relative, F.when(own, 3).otherwise(2)).when(is_alias, F.when(F.col("is_package"), 2).otherwise(1)).when(is_class & F.col("found").isNotNull(), 3).otherwise(F.col("certainty"))
    prefix = F.when(is_import, F.when(~standard & known, "mod").otherwise("extmod")).otherwise(F.col("prefix"))
    target = F.when(F.col("ref").isin("class", "known class"), F.coalesce("found", "qualified_name")).otherwise(F.col("qualified_name"))
    return f.withColumn("prefix", prefix).withColumn("qualified_name", target).withColumn("certainty", certainty).drop("k", "top", "is_module", "is_top", "is_package", "found")


def _ids(prefix: str, name: str):
    """The identifier of a fact's end; names with bars stand for several parts."""
    return F.concat(F.col(prefix), F.lit(":"), F.substring(F.sha2(F.col(name), 256), 1, 16))


def emissions(facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(node emissions, edge emissions, warnings) of settled facts; seq orders them as one pass over the files would."""
    seq = (F.col("stage").cast("long") * (1 << 50) + F.col("file").cast("long") * (1 << 24) + F.col("n").cast("long") * 2).alias("seq")
    # an endpoint's identity joins its parts by bars; its name is what is shown
    qualified = F.when(F.col("type").isin("ENDPOINT", "EXTERNAL_ENDPOINT"), F.col("display_name")).otherwise(F.col("qualified_name")).alias("qualified_name")
    nodes = facts.where("kind = 'node'").select(
        _ids("prefix", "qualified_name").alias("id"), "type", "name", qualified, "display_name", "file_path", "line_number", F.lit(None).cast("int").alias("column"), "certainty", F.col("meta").alias("metadata"), seq
    )
    edges = facts.where("kind = 'edge'")
    # import targets, dependencies and annotations are nodes too
    ends = edges.where("ref in ('module', 'relative', 'class', 'known class')").select(
        _ids("prefix", "qualified_name").alias("id"), F.when(F.col("prefix") == "mod", "MODULE").when(F.col("prefix") == "extmod", "EXTERNAL_MODULE").otherwise("FUNCTION").alias("type"), F.element_at(F.split("qualified_name", "::"), -1).alias("name"),
        "qualified_name", F.col("qualified_name").alias("display_name"), F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("int").alias("line_number"), F.lit(None).cast("int").alias("column"), "certainty",
        F.create_map().cast("map<string,string>").alias("metadata"), (seq + 1).alias("seq"),
    )
    from_, to = _ids("source_prefix", "source"), _ids("prefix", "qualified_name")
    shown = F.replace(F.replace("display_name", F.lit(SOURCE_ID), from_), F.lit(TARGET_ID), to).alias("display_name")
    out = edges.select(from_.alias("source_id"), to.alias("target_id"), "type", shown, "file_path", "line_number", "certainty", F.col("meta").alias("metadata"), seq)
    warnings = facts.where("kind = 'warning'").select(F.col("type").alias("code"), F.col("name").alias("message"), F.col("file_path").alias("path"), "certainty")
    return nodes.unionByName(ends), out, warnings


def _with_topology(spark, nodes: DataFrame, edges: DataFrame, services: list[dict]) -> tuple[DataFrame, DataFrame]:
    """Service and component nodes, membership by the longest directory, and parallel edges for boundaries crossed."""
    rows = [(x["dir"], x["kind"], x["name"], x["path"], x["certainty"], x["meta"], k) for k, x in enumerate(services)]
    s = spark.createDataFrame(rows, "dir string, type string, name string, file_path string, certainty int, metadata map<string,string>, seq long")
    s = s.withColumn("id", F.concat(F.when(F.col("type") == "SERVICE", "svc").otherwise("comp"), F.lit(":"), F.substring(F.sha2("name", 256), 1, 16)))
    files = nodes.where("file_path is not null and type not in ('SERVICE', 'COMPONENT')").select(F.col("file_path").alias("path")).distinct()
    place = longest_directory(files, s.where("dir is not null and dir <> ''").select("dir", F.col("id").alias("service")))
    whole = next((x["id"] for x in s.where("dir = ''").select("id").collect()), None)  # the service of the root holds what no other does
    if whole:
        place = files.join(place, "path", "left").withColumn("service", F.coalesce("service", F.lit(whole)))
    member = nodes.join(place, nodes.file_path == place.path).select("id", "service", "file_path", "type", F.col("display_name").alias("shown"))
    names = s.select(F.col("id").alias("service"), "name")
    belongs = member.where("type in ('MODULE', 'PACKAGE')").join(names, "service")
    belongs = belongs.select(F.col("id").alias("source_id"), F.col("service").alias("target_id"), F.lit("BELONGS_TO_SERVICE").alias("type"), F.concat("shown", F.lit(" belongs to "), "name").alias("display_name"), "file_path", F.lit(None).cast("int").alias("line_number"), F.lit(3).alias("certainty"), F.create_map().cast("map<string,string>").alias("metadata"))
    ends = lambda side: nodes.select(F.col("id").alias(f"{side}_id"), F.col("display_name").alias(f"{side}_shown"))
    cross = crossings(edges, member.select("id", "service")).join(ends("source"), "source_id").join(ends("target"), "target_id")
    cross = cross.join(names.select(F.col("service").alias("source_service"), F.col("name").alias("a")), "source_service").join(names.select(F.col("service").alias("target_service"), F.col("name").alias("b")), "target_service")
    cross = cross.select("source_id", "target_id", F.lit("CROSSES_COMPONENT_BOUNDARY").alias("type"), F.concat("source_shown", F.lit(" -> "), "target_shown", F.lit(" [cross-boundary: "), "a", F.lit(" -> "), "b", F.lit("]")).alias("display_name"), "file_path", "line_number", "certainty", F.create_map(F.lit("from_service"), "a", F.lit("to_service"), "b").alias("metadata"), F.conv(F.substring("id", -15, 15), 16, 10).cast("long").alias("seq"))
    served = nodes.where("type = 'ENDPOINT'").join(member.select("id", "service"), "id").groupBy("service").agg(F.to_json(F.sort_array(F.collect_list("display_name"))).alias("endpoints"))
    s = s.join(served, s.id == served.service, "left").withColumn("metadata", F.when(F.col("endpoints").isNull(), F.col("metadata")).otherwise(F.map_concat("metadata", F.create_map(F.lit("endpoints"), "endpoints"))))
    s = s.select("id", "type", "name", F.col("name").alias("qualified_name"), F.col("name").alias("display_name"), "file_path", F.lit(None).cast("int").alias("line_number"), F.lit(None).cast("int").alias("column"), "certainty", "metadata", "seq")
    more = belongs.withColumn("seq", F.lit(0).cast("long")).unionByName(cross)
    return nodes.unionByName(merge_nodes(s)), edges.unionByName(merge_edges(more))


def _with_stitches(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls from JavaScript to endpoints of the same path."""
    js = nodes.where("type = 'EXTERNAL_ENDPOINT' and element_at(metadata, 'source') = 'js'").select(F.col("id").alias("called"), F.element_at("metadata", "url").alias("url")).where("url <> '<dynamic>'")
    ends = nodes.where("type = 'ENDPOINT'").select(F.col("id").alias("target_id"), F.element_at("metadata", "path").alias("path"))
    calls = edges.where("type = 'CALLS_HTTP'").select("source_id", F.col("target_id").alias("called"), F.col("display_name").alias("shown"), "file_path", "line_number")
    new = stitch(js, ends).join(calls, "called").groupBy("source_id", "target_id").agg(F.min(F.struct("called", "url", "shown", "file_path", "line_number")).alias("x"))
    new = new.select(
        "source_id", "target_id", F.lit("CALLS_HTTP").alias("type"), F.concat("x.shown", F.lit(" [cross-language]")).alias("display_name"), "x.file_path", "x.line_number", F.lit(2).alias("certainty"),
        F.create_map(F.lit("stitched"), F.lit("true"), F.lit("url"), "x.url").alias("metadata"), F.lit(0).cast("long").alias("seq"),
    )
    return edges.unionByName(merge_edges(new))


def assemble(facts: DataFrame, services: list[dict] | None = None, listing_warnings=()) -> Graph:
    """The graph of a table of facts (and of the services' descriptions)."""
    spark = facts.sparkSession
    n, e, w = emissions(materialize(resolved(facts), "resolved"))
    nodes, edges = materialize(merge_nodes(n), "nodes"), materialize(merge_edges(e), "edges")
    edges = _with_stitches(nodes, edges)
    if services:
        nodes, edges = _with_topology(spark, nodes, edges, services)
    w = w.unionByName(spark.createDataFrame([tuple(x) for x in listing_warnings], "code string, message string, path string, certainty int"))
    return Graph(nodes, edges, w)


def build(spark: SparkSession, options: ScanOptions, added=()) -> Graph:
    """Scan a tree from scratch. ``added``: see ``extract``."""
    sources, files, warnings = sources_table(spark, options)
    facts = materialize(extract(sources, added), "facts")
    g = assemble(facts, configs.topology(configs.Folder(os.path.realpath(options.root)), [p for p, k in files if k == "config"]), warnings)
    g.metadata = {"root_path": os.path.realpath(options.root), "total_files": len(files)}
    return g
