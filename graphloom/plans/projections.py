"""The driver's tables as tables of the model, for DataFrames and, as SQL text, for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.resolve import resolve_calls

#: Two repositories share the tables; parts whose size is a multiple of five belong to the other one.
REPOSITORY, OTHER = "repo_main", "repo_other"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A symbol for each part: name from brand, type and name; language by size; fingerprint of the price."""
    p = read(spark, sf_dir, "part")
    language = F.element_at(F.array(*map(F.lit, ("java", "php", "python", "typescript"))), F.pmod("p_size", F.lit(4)) + 1)
    return p.select(
        F.when(F.pmod("p_size", F.lit(5)) == 0, OTHER).otherwise(REPOSITORY).alias("repository_id"),
        F.col("p_partkey").cast("string").alias("symbol_id"),
        language.alias("language"),
        F.lit("function").alias("kind"),
        F.concat_ws(".", F.translate("p_brand", "#", ""), "p_type", F.translate("p_name", " ", "_")).alias("fqn"),
        F.concat(F.lit("("), F.col("p_size").cast("string"), F.lit(")")).alias("signature"),
        F.col("p_brand").alias("relative_path"),
        F.col("p_size").alias("start_line"),
        (F.col("p_size") + 10).alias("end_line"),
        F.md5(F.round(F.col("p_retailprice") * 100).cast("bigint").cast("string")).alias("ast_fingerprint"),
    )


SYMBOLS = """p AS (
  SELECT CASE WHEN p_size % 5 = 0 THEN 'repo_other' ELSE 'repo_main' END AS repository_id, CAST(p_partkey AS VARCHAR) AS symbol_id, ['java', 'php', 'python', 'typescript'][p_size % 4 + 1] AS language,
    'function' AS kind, replace(p_brand, '#', '') || '.' || p_type || '.' || replace(p_name, ' ', '_') AS fqn, '(' || p_size || ')' AS signature,
    p_brand AS relative_path, p_size AS start_line, p_size + 10 AS end_line, md5(CAST(CAST(round(p_retailprice * 100) AS BIGINT) AS VARCHAR)) AS ast_fingerprint FROM part)"""


def next_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, rn, caller, callee ...): within an order each line and the next, in a total order."""
    lines = read(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    return lines.select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", F.col("l_partkey").alias("caller"), F.lead("l_partkey").over(w).alias("callee"), F.row_number().over(w).alias("rn")).where("callee is not null")


NEXT = """n AS (
  SELECT * FROM (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_partkey AS caller, lead(l_partkey) OVER w AS callee, row_number() OVER w AS rn FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)) WHERE callee IS NOT NULL)"""


def raw_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line calls the next line's part by its simple name; qualified if returned, typed if the line is open. A
    call belongs to its caller's repository, whatever the other part's."""
    s = symbols(spark, sf_dir)
    calls = next_lines(spark, sf_dir)
    caller = s.select("repository_id", F.col("symbol_id").alias("caller_symbol_id"), "language")
    callee = s.select(F.col("symbol_id").alias("to"), F.substring_index("fqn", ".", -1).alias("target_name"), F.element_at(F.split("fqn", r"\."), -2).alias("owner"))
    met = calls.join(caller, F.col("caller").cast("string") == F.col("caller_symbol_id")).join(callee, F.col("callee").cast("string") == F.col("to"))
    qualified = F.col("l_returnflag") == "R"
    return met.select("repository_id", "l_orderkey", "rn", "caller_symbol_id", "language", "target_name", F.when(qualified, F.concat(F.lit("x."), F.col("target_name"))).otherwise(F.col("target_name")).alias("display_target"), qualified.alias("is_qualified"), F.when(F.col("l_linestatus") == "O", F.col("owner")).alias("receiver_type"), F.lit(None).cast("string").alias("receiver_module"), F.col("l_linenumber").alias("source_line"))


CALLS = """c AS (
  SELECT a.repository_id, n.l_orderkey, n.rn, a.symbol_id AS caller_symbol_id, a.language, a.fqn AS caller_fqn, a.relative_path AS caller_path, split_part(b.fqn, '.', -1) AS target_name,
    n.l_returnflag = 'R' AS is_qualified, CASE WHEN n.l_linestatus = 'O' THEN split_part(b.fqn, '.', -2) END AS receiver_type, n.l_linenumber AS source_line
  FROM n JOIN p a ON a.symbol_id = CAST(n.caller AS VARCHAR) JOIN p b ON b.symbol_id = CAST(n.callee AS VARCHAR))"""


def call_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of all calls, as the resolver leaves them."""
    found = resolve_calls(symbols(spark, sf_dir), raw_calls(spark, sf_dir), keep=("repository_id", "l_orderkey", "rn"))
    return found.select((F.col("l_orderkey") * 1000 + F.col("rn")).alias("edge_id"), "repository_id", "caller_symbol_id", "callee_symbol_id", "unresolved_name", "confidence", "source_line")


RESOLVED = r"""s AS (SELECT *, CASE WHEN language = 'php' THEN lower(split_part(fqn, '.', -1)) ELSE split_part(fqn, '.', -1) END AS nm, regexp_extract(fqn, '^(.*)\.[^.]*$', 1) AS scope, split_part(fqn, '.', -2) AS owner FROM p),
g AS (SELECT c.*, CASE WHEN c.language = 'php' THEN lower(target_name) ELSE target_name END AS nm, regexp_extract(caller_fqn, '^(.*)\.[^.]*$', 1) AS scope FROM c),
a1 AS (SELECT repository_id, language, scope, nm, count(*) AS n, min(symbol_id) AS id FROM s GROUP BY ALL), a2 AS (SELECT repository_id, language, relative_path, nm, count(*) AS n, min(symbol_id) AS id FROM s GROUP BY ALL),
a3 AS (SELECT repository_id, language, nm, count(*) AS n, min(symbol_id) AS id FROM s GROUP BY ALL), a4 AS (SELECT repository_id, language, owner, nm, count(*) AS n, min(symbol_id) AS id FROM s GROUP BY ALL),
v AS (SELECT g.*, CASE WHEN receiver_type IS NOT NULL THEN coalesce(a4.n, 0) WHEN a1.n > 0 THEN a1.n WHEN a2.n > 0 AND NOT is_qualified THEN a2.n ELSE coalesce(a3.n, 0) END AS cnt,
  CASE WHEN receiver_type IS NOT NULL THEN a4.id WHEN a1.n > 0 THEN a1.id WHEN a2.n > 0 AND NOT is_qualified THEN a2.id ELSE a3.id END AS id,
  coalesce(CASE WHEN a1.n > 0 THEN a1.n WHEN a2.n > 0 AND NOT is_qualified THEN a2.n ELSE a3.n END, 0) AS web
  FROM g LEFT JOIN a1 ON a1.repository_id = g.repository_id AND a1.language = g.language AND a1.scope = g.scope AND a1.nm = g.nm LEFT JOIN a2 ON a2.repository_id = g.repository_id AND a2.language = g.language AND a2.relative_path = g.caller_path AND a2.nm = g.nm
  LEFT JOIN a3 ON a3.repository_id = g.repository_id AND a3.language = g.language AND a3.nm = g.nm LEFT JOIN a4 ON a4.repository_id = g.repository_id AND a4.language = g.language AND a4.owner = g.receiver_type AND a4.nm = g.nm),
w AS (SELECT *, CASE WHEN cnt = 1 AND (receiver_type IS NOT NULL OR NOT is_qualified) THEN 'resolved' WHEN cnt = 0 THEN 'unresolved' ELSE 'ambiguous' END AS confidence FROM v)"""


EDGES = """e AS (
  SELECT l_orderkey * 1000 + rn AS edge_id, repository_id, caller_symbol_id AS a, CASE WHEN confidence = 'resolved' THEN id END AS b,
    CASE WHEN confidence <> 'resolved' THEN CASE WHEN is_qualified THEN 'x.' ELSE '' END || target_name END AS unresolved_name, source_line FROM w)"""


def second_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The symbols after an edit: some dropped, some added, some with another body or path."""
    s = symbols(spark, sf_dir).withColumn("k", F.col("symbol_id").cast("bigint"))
    kept = s.where("k % 11 <> 0")
    added = s.where("k % 17 = 0").withColumn("fqn", F.concat("fqn", F.lit("_v2"))).withColumn("symbol_id", F.concat(F.lit("v2_"), F.col("symbol_id")))
    out = kept.unionByName(added)
    return out.withColumn("ast_fingerprint", F.when(F.col("k") % 7 == 0, F.md5(F.concat("ast_fingerprint", F.lit("2")))).otherwise(F.col("ast_fingerprint"))).withColumn("relative_path", F.when(F.col("k") % 13 == 0, F.concat("relative_path", F.lit("/moved"))).otherwise(F.col("relative_path"))).drop("k")


SECOND = """p2 AS (
  SELECT repository_id, symbol_id, language, kind, fqn, signature, CASE WHEN k % 13 = 0 THEN relative_path || '/moved' ELSE relative_path END AS relative_path, start_line, end_line,
    CASE WHEN k % 7 = 0 THEN md5(ast_fingerprint || '2') ELSE ast_fingerprint END AS ast_fingerprint
  FROM (SELECT *, CAST(symbol_id AS BIGINT) AS k FROM p WHERE CAST(symbol_id AS BIGINT) % 11 <> 0
    UNION ALL BY NAME SELECT * REPLACE (fqn || '_v2' AS fqn, 'v2_' || symbol_id AS symbol_id), CAST(symbol_id AS BIGINT) AS k FROM p WHERE CAST(symbol_id AS BIGINT) % 17 = 0))"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collection items of the conversations' turns, each of a part's symbol; some captures are stale, some ids gone. The memo is
    the whole turn."""
    c = read(spark, sf_dir, "conversations")
    n = read(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    keyed = c.join(F.broadcast(n)).withColumn("k", F.pmod(F.col("conv_id") * 31 + F.col("turn") * 7, F.col("n")).cast("string"))
    s = symbols(spark, sf_dir).select("repository_id", F.col("symbol_id").alias("k"), "fqn", "signature", F.col("relative_path").alias("path"), "start_line", "end_line", "ast_fingerprint")
    met = keyed.join(s, "k")
    stale = F.col("turn") % 3 == 1
    return met.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("collection_id"), "repository_id", F.when(F.col("turn") % 5 == 4, None).otherwise(F.col("k")).alias("symbol_id"), F.col("fqn").alias("symbol_fqn"), F.col("signature").alias("symbol_signature"), F.col("path").alias("relative_path"), "start_line", "end_line", F.when(stale, F.md5(F.concat("ast_fingerprint", F.lit("old")))).otherwise(F.col("ast_fingerprint")).alias("ast_fingerprint"), "role", F.col("text").alias("memo"), F.when(F.col("turn") % 5 == 4, "orphan").otherwise("linked").alias("status"), (F.col("turn") * 10).alias("sort_order"))


ITEMS = """i AS (
  SELECT c.conv_id * 1000 + c.turn AS id, c.conv_id AS collection_id, p.repository_id, CASE WHEN c.turn % 5 <> 4 THEN p.symbol_id END AS symbol_id, p.fqn AS symbol_fqn,
    p.signature AS symbol_signature, p.relative_path, p.start_line, p.end_line, CASE WHEN c.turn % 3 = 1 THEN md5(p.ast_fingerprint || 'old') ELSE p.ast_fingerprint END AS ast_fingerprint,
    c.role, c.text AS memo, CASE WHEN c.turn % 5 = 4 THEN 'orphan' ELSE 'linked' END AS status, c.turn * 10 AS sort_order
  FROM conversations c JOIN p ON p.symbol_id = CAST((c.conv_id * 31 + c.turn * 7) % (SELECT count(*) FROM part) AS VARCHAR))"""


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection for each conversation, titled by its first turn; two more without items."""
    c = read(spark, sf_dir, "conversations")
    own = c.groupBy(F.col("conv_id").alias("id")).agg(F.min_by("text", "turn").alias("title"), F.max("turn").alias("last"))
    empty = c.agg((F.max("conv_id") + 1).alias("id")).select("id", F.lit("empty").alias("title"), F.lit(0).cast("bigint").alias("last"))
    every = own.union(empty)
    return every.select("id", F.lit(REPOSITORY).alias("repository_id"), "title", F.concat(F.lit("turns: "), F.col("last").cast("string")).alias("overview_markdown"), F.array(F.concat(F.lit("tag"), (F.col("id") % 4).cast("string"))).alias("tags"))


COLLECTIONS = """k AS (
  SELECT id, 'repo_main' AS repository_id, title, 'turns: ' || last AS overview_markdown, ['tag' || (id % 4)] AS tags FROM (
    SELECT conv_id AS id, arg_min(text, turn) AS title, max(turn) AS last FROM conversations GROUP BY conv_id
    UNION ALL SELECT max(conv_id) + 1, 'empty', 0 FROM conversations))"""


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note for each order, on a part's symbol; drafts and repeated notes a symbol are many."""
    o = read(spark, sf_dir, "orders")
    s = symbols(spark, sf_dir).select("repository_id", F.col("symbol_id").alias("k"), "fqn", "signature")
    n = read(spark, sf_dir, "part").agg(F.count("*").alias("n"))
    met = o.join(F.broadcast(n)).withColumn("k", F.pmod("o_custkey", F.col("n")).cast("string")).join(s, "k")
    return met.select(F.col("o_orderkey").alias("id"), "repository_id", F.col("k").alias("symbol_id"), F.col("fqn").alias("symbol_fqn"), F.col("signature").alias("symbol_signature"), F.concat(F.lit("  Note on "), F.col("o_orderpriority"), F.lit(" ")).alias("title"), F.concat(F.lit("See [line:"), (F.col("o_orderkey") % 50).cast("string"), F.lit("-"), (F.col("o_custkey") % 40).cast("string"), F.lit("] & <more>")).alias("body_markdown"), F.array(F.lit(" a "), F.lit(""), F.col("o_orderstatus")).alias("tags"), F.when(F.col("o_orderstatus") == "F", "orphan").otherwise("linked").alias("status"), F.col("o_orderdate").alias("updated_at"))


NOTES = """o AS (
  SELECT o_orderkey AS id, p.repository_id, p.symbol_id, p.fqn AS symbol_fqn, p.signature AS symbol_signature, '  Note on ' || o_orderpriority || ' ' AS title,
    'See [line:' || (o_orderkey % 50) || '-' || (o_custkey % 40) || '] & <more>' AS body_markdown, [' a ', '', o_orderstatus] AS tags, CASE WHEN o_orderstatus = 'F' THEN 'orphan' ELSE 'linked' END AS status, o_orderdate AS updated_at
  FROM orders JOIN p ON p.symbol_id = CAST(o_custkey % (SELECT count(*) FROM part) AS VARCHAR))"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis runs from events: a user is a repository, an event a run whose type gives its status."""
    e = read(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("value") > 20, "partial").otherwise("completed")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("repository_id"), F.concat(F.lit("rev"), (F.col("event_id") % 97).cast("string")).alias("revision"), status.alias("status"), F.when(F.col("event_type") != "view", F.col("ts")).alias("completed_at"))


RUNS = """r AS (
  SELECT event_id AS id, CAST(user_id AS VARCHAR) AS repository_id, 'rev' || (event_id % 97) AS revision, CASE WHEN event_type = 'error' THEN 'failed' WHEN value > 20 THEN 'partial' ELSE 'completed' END AS status,
    CASE WHEN event_type <> 'view' THEN ts END AS completed_at FROM events)"""
