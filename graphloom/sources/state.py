"""The JSON state of a browser session: read with its migrations, written without raw sources; and workspace states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.redaction import without_sources

STATE_VERSION = 3
_SYMBOL = "struct<id:string,language:string,kind:string,fqn:string,signature:string,relativePath:string,startLine:int,endLine:int,astFingerprint:string>"
_EDGE = "struct<id:bigint,source:string,target:string,unresolvedName:string,confidence:string,sourceLine:int>"
_REPOSITORY = "struct<id:string,rootPath:string,displayName:string,branch:string,head:string,isDirty:boolean,createdAt:string,updatedAt:string>"
_NOTE = "struct<id:bigint,symbolId:string,title:string,bodyMarkdown:string,tags:array<string>,updatedAt:string,status:string>"
_COLLECTION = "struct<id:bigint,repositoryId:string,title:string,overviewMarkdown:string,tags:array<string>,createdRevision:string,createdAt:string,updatedAt:string>"
_ITEM = "struct<id:bigint,collectionId:bigint,repositoryId:string,symbolId:string,symbolFqn:string,symbolSignature:string,relativePath:string,startLine:int,endLine:int,astFingerprint:string,role:string,memo:string,status:string,sortOrder:bigint,addedRevision:string,reviewedAt:string,createdAt:string,updatedAt:string>"
#: What of a state is read. Fields that aren't named, raw sources of files among them, are left out.
DATA = f"struct<index:struct<repository:{_REPOSITORY},symbols:array<{_SYMBOL}>,edges:array<{_EDGE}>,diagnostics:array<string>>,notes:array<{_NOTE}>,collections:array<{_COLLECTION}>,collectionItems:array<{_ITEM}>,workspace:struct<selectedSymbolId:string,graphDepth:int,selectedCollectionId:bigint,reanalysisRequired:boolean>,counters:struct<noteId:bigint,collectionId:bigint,collectionItemId:bigint>>"
_FIELDS = ("index", "notes", "collections", "collectionItems", "workspace", "counters")


def _struct_with(c: Column, kind: str, **new: Column) -> Column:
    """A struct's fields, some of them replaced."""
    names = [f.split(":", 1)[0] for f in _split_fields(kind)]
    return F.struct(*[(new[n] if n in new else c[n]).alias(n) for n in names])


def _split_fields(kind: str) -> list[str]:
    body, out, depth, at = kind.removeprefix("struct<")[:-1], [], 0, 0
    for i, ch in enumerate(body):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(body[at:i])
            at = i + 1
    return [*out, body[at:]]


def migrated(version: Column, data: Column) -> list[Column]:
    """The parts of a state of a version, as those of the present one.

    What is missing gets its default. Before 2, items without a sort order get their place in the list; before 3, an
    index with any edge without a source is dropped, with the selected symbol, and asks for a new analysis."""
    some = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    items = some(data["collectionItems"], _ITEM)
    placed = F.transform(items, lambda x, i: _struct_with(x, _ITEM, sortOrder=F.coalesce(x["sortOrder"], i.cast("bigint"))))
    lost = (version < 3) & F.coalesce(F.exists(data["index"]["edges"], lambda e: F.coalesce(e["source"], F.lit("")) == ""), F.lit(False))
    w, n = data["workspace"], data["counters"]
    workspace = F.struct(F.when(~lost, w["selectedSymbolId"]).alias("selectedSymbolId"), F.coalesce(w["graphDepth"], F.lit(2)).alias("graphDepth"), w["selectedCollectionId"].alias("selectedCollectionId"), (lost | F.coalesce(w["reanalysisRequired"], F.lit(False))).alias("reanalysisRequired"))
    counters = F.struct(*[F.coalesce(n[c], F.lit(1).cast("bigint")).alias(c) for c in ("noteId", "collectionId", "collectionItemId")])
    return [F.when(~lost, data["index"]).alias("index"), some(data["notes"], _NOTE).alias("notes"), some(data["collections"], _COLLECTION).alias("collections"), F.when(version < 2, placed).otherwise(items).alias("collectionItems"), workspace.alias("workspace"), counters.alias("counters")]


def parse_states(texts: DataFrame, text: str = "value") -> DataFrame:
    """(index, notes, collections, collectionItems, workspace, counters) of each JSON text.

    An envelope (kind, version, data) of a newer version is an error; a text without an envelope is a state of version 1."""
    found = texts.select(F.from_json(text, f"kind string, version int, data {DATA}").alias("e"), F.from_json(text, DATA).alias("bare"))
    wrapped = F.col("e.kind").isNotNull()
    version = F.when(wrapped, F.coalesce("e.version", F.lit(1))).otherwise(1)
    newer = F.raise_error(F.concat(F.lit("the state is of a newer version: "), version.cast("string"))).cast("int")
    found = found.select(F.when(version > STATE_VERSION, newer).otherwise(version).alias("version"), F.when(wrapped, F.col("e.data")).otherwise(F.col("bare")).alias("data"))
    return found.select(*migrated(F.col("version"), F.col("data")))


def read_state(spark: SparkSession, path: str) -> DataFrame:
    """The state document at a path; see parse_states. A path without a document gives the state with all defaults."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    texts = spark.read.text(path, wholetext=True) if there else spark.createDataFrame([("{}",)], "value string")
    return parse_states(texts)


def state_json(kind: str = "graphloom.state", saved_at: Column | None = None) -> Column:
    """The envelope of a state's columns. Only the state's own fields are written, so no raw source is."""
    data = F.struct(*_FIELDS)
    at = F.date_format(F.current_timestamp() if saved_at is None else saved_at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.to_json(F.struct(F.lit(kind).alias("kind"), F.lit(STATE_VERSION).alias("version"), at.alias("savedAt"), data.alias("data")), {"pretty": "true"})


def write_state(state: DataFrame, path: str) -> None:
    state.select(state_json().alias("value")).write.mode("overwrite").text(path)


def redacted_states(texts: DataFrame, text: str = "value") -> DataFrame:
    """texts with raw sources taken out of the JSON column, at any depth; fields that the model doesn't know stay.

    What isn't JSON becomes null."""
    return texts.withColumn(text, without_sources(F.col(text)))


# workspace states of the desktop variant

#: Names of workspaces, and what older ones are called now (fixed values).
WORKSPACES = {"explore": "explore", "record": "record", "collections": "collections", "find": "explore", "understand": "explore"}


def workspace_state(text: str = "state_json") -> list[Column]:
    """Columns of a workspace state from a JSON text; valid is false where the whole state is to be refused.

    The version must be 1, the workspace a known one, the query a text, the depth a whole number from 1 to 3 and the drafts
    a list. What else isn't as it should be is null, or 0 for places in a text."""
    v = F.try_parse_json(F.col(text))
    kind = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    number = lambda path: F.when(kind(path).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, path, "double"))
    whole = lambda path: F.when(number(path) == F.floor(number(path)), number(path).cast("bigint"))
    string = lambda path: F.when(kind(path) == "STRING", F.try_variant_get(v, path, "string"))
    names = F.create_map(*[F.lit(x) for pair in WORKSPACES.items() for x in pair])
    workspace = F.try_element_at(names, F.coalesce(string("$.activeWorkspace"), F.lit("")))
    depth = whole("$.depth")
    valid = (number("$.version") == 1) & workspace.isNotNull() & string("$.query").isNotNull() & depth.between(1, 3) & kind("$.noteDrafts").startswith("ARRAY")

    def span(path: str, least: int) -> Column:
        first, last = whole(f"{path}.start"), whole(f"{path}.end")
        return F.when((first >= least) & (last >= first), F.struct(first.alias("start"), last.alias("end")))

    place = lambda path: F.when(number(path) >= 0, number(path)).otherwise(0.0)
    zoom, x, y = (number(f"$.graphViewport.{c}") for c in ("zoom", "panX", "panY"))
    viewport = F.when((zoom > 0) & x.isNotNull() & y.isNotNull(), F.struct(zoom.alias("zoom"), x.alias("panX"), y.alias("panY")))
    parts = {"active_workspace": workspace, "query": string("$.query"), "depth": depth, "selected_note_id": whole("$.selectedNoteId"), "line_range": span("$.lineReferenceRange", 1), "viewport": viewport, "source_scroll_top": place("$.sourceScrollTop"), "markdown_selection": span("$.markdownSelection", 0), "markdown_scroll_top": place("$.markdownScrollTop"), "selected_collection_id": whole("$.selectedCollectionId"), "drafts": F.size(F.try_variant_get(v, "$.noteDrafts", "array<variant>"))}
    good = F.coalesce(valid, F.lit(False))
    return [good.alias("valid"), *[F.when(good, c).alias(n) for n, c in parts.items()]]


def workspace_json(selected_symbol: Column | None = None, drafts: Column | None = None) -> Column:
    """The JSON text of a workspace state's columns; workspace_state() reads it back."""
    names = {"activeWorkspace": "active_workspace", "query": "query", "depth": "depth", "selectedNoteId": "selected_note_id", "lineReferenceRange": "line_range", "graphViewport": "viewport", "sourceScrollTop": "source_scroll_top", "markdownSelection": "markdown_selection", "markdownScrollTop": "markdown_scroll_top", "selectedCollectionId": "selected_collection_id"}
    none = F.array().cast("array<string>") if drafts is None else drafts
    parts = [F.lit(1).alias("version"), *[F.col(c).alias(n) for n, c in names.items()], none.alias("noteDrafts")]
    return F.to_json(F.struct(*parts, *([] if selected_symbol is None else [selected_symbol.alias("selectedSymbol")])))
