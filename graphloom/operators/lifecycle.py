"""Notes, collections, items and snapshots across analyses: re-linking, order, upserts, promotion, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .orders import placed


def within(repository_id: str, *tables: DataFrame) -> tuple[DataFrame, ...]:
    """The rows of one repository: what a search, a graph or a list is asked of."""
    return tuple(t.where(F.col("repository_id") == repository_id) for t in tables)


def lookup(rows: DataFrame, **keys: object) -> DataFrame:
    """The rows with these values in these columns: one at most where the columns are a key. A pushed-down filter."""
    for column, value in keys.items():
        rows = rows.where(F.col(column).eqNullSafe(F.lit(value)))
    return rows


def unique_match(symbols: DataFrame, keys: list[str]) -> DataFrame:
    """(repository_id, keys.., symbol_id) where exactly one symbol of the repository bears the keys."""
    return symbols.groupBy("repository_id", *keys).agg(F.count("*").alias("n"), F.min("symbol_id").alias("symbol_id")).where("n = 1").drop("n")


def relink_notes(notes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Notes after an analysis: one whose (fqn, signature) stands among the symbols is linked to the least such id;
    any other is an orphan and keeps its old symbol_id. updated_at isn't touched. Repositories don't see each other."""
    found = symbols.groupBy("repository_id", F.col("fqn").alias("symbol_fqn"), F.col("signature").alias("symbol_signature")).agg(F.min("symbol_id").alias("new_id"))
    alive = symbols.select("repository_id", "symbol_id").distinct().withColumn("alive", F.lit(True))
    met = notes.join(found, ["repository_id", "symbol_fqn", "symbol_signature"], "left").join(alive, ["repository_id", "symbol_id"], "left")
    status = F.when(F.col("new_id").isNotNull() | F.col("alive").isNotNull(), "linked").otherwise("orphan")
    return met.withColumn("status", status).withColumn("symbol_id", F.coalesce("new_id", "symbol_id")).select(*notes.columns)


def relink_items(items: DataFrame, symbols: DataFrame) -> DataFrame:
    """Collection items after an analysis.

    An item whose symbol is gone is orphaned (id null). Orphans are then matched by unique (fqn, signature), else by unique
    fingerprint; a target that a linked item of the collection holds is refused, and of several orphans with one
    target the least item id gets it. Location and names follow the target, the captured fingerprint doesn't."""
    repo = "repository_id"
    alive = symbols.select(repo, "symbol_id").distinct().withColumn("alive", F.lit(True))
    seen = items.join(alive, [repo, "symbol_id"], "left")
    held = seen.where(F.col("alive") & (F.col("status") == "linked"))
    lost = seen.where(~(F.coalesce("alive", F.lit(False)) & (F.col("status") == "linked"))).withColumn("symbol_id", F.lit(None).cast("string"))
    named = unique_match(symbols, ["fqn", "signature"]).select(repo, F.col("fqn").alias("symbol_fqn"), F.col("signature").alias("symbol_signature"), F.col("symbol_id").alias("by_name"))
    printed = unique_match(symbols, ["ast_fingerprint"]).withColumnRenamed("symbol_id", "by_print")
    aimed = lost.join(named, [repo, "symbol_fqn", "symbol_signature"], "left").join(printed, [repo, "ast_fingerprint"], "left").withColumn("target", F.coalesce("by_name", "by_print"))
    taken = held.select("collection_id", F.col("symbol_id").alias("target")).distinct().withColumn("taken", F.lit(True))
    aimed = aimed.join(taken, ["collection_id", "target"], "left")
    free = F.col("target").isNotNull() & F.col("taken").isNull()
    first = F.row_number().over(Window.partitionBy("collection_id", F.when(free, F.col("target")), free, F.when(~free, F.col("id"))).orderBy("id")) == 1
    aimed = aimed.withColumn("won", first & free)
    now = symbols.groupBy(repo, F.col("symbol_id").alias("target")).agg(F.min(F.struct("fqn", "signature", "relative_path", "start_line", "end_line")).alias("now"))
    met = aimed.join(now, [repo, "target"], "left")
    fresh = {"symbol_id": F.col("target"), "symbol_fqn": F.col("now.fqn"), "symbol_signature": F.col("now.signature"), "relative_path": F.col("now.relative_path"), "start_line": F.col("now.start_line"), "end_line": F.col("now.end_line"), "status": F.lit("linked")}
    old = {c: F.lit("orphan") if c == "status" else F.col(c) for c in items.columns}
    done = met.select(*[F.when(F.col("won"), fresh[c]).otherwise(old[c]).alias(c) if c in fresh else F.col(c) for c in items.columns])
    return held.select(*items.columns).union(done)


def item_details(items: DataFrame, symbols: DataFrame) -> DataFrame:
    """Items with their current symbol (null struct if there is none) and whether its body changed since capture."""
    now = symbols.select(F.col("repository_id"), F.col("symbol_id"), F.struct(*[c for c in symbols.columns if c != "repository_id"]).alias("current_symbol"))
    met = items.join(now, ["repository_id", "symbol_id"], "left")
    changed = (F.col("status") == "linked") & F.col("current_symbol").isNotNull() & (F.col("current_symbol.ast_fingerprint") != F.col("ast_fingerprint"))
    return met.withColumn("is_changed", F.coalesce(changed, F.lit(False)))


def collection_summaries(collections: DataFrame, items: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each collection with item_count, orphan_count and changed_count; 0 for an empty one."""
    n = item_details(items, symbols).groupBy(F.col("collection_id").alias("id")).agg(F.count("*").alias("item_count"), F.count_if(F.col("status") == "orphan").alias("orphan_count"), F.count_if("is_changed").alias("changed_count"))
    return collections.join(n, "id", "left").na.fill(0, ["item_count", "orphan_count", "changed_count"])


def search_collections(collections: DataFrame, items: DataFrame, query: str) -> DataFrame:
    """Collections that hold the query, as plain text in any case, in their or an item's texts."""
    q = F.lit(query.lower())
    has = lambda *cs: F.exists(F.array(*[F.coalesce(F.lower(c), F.lit("")) for c in cs]), lambda x: F.contains(x, q))
    own = collections.where(has("title", "overview_markdown", F.to_json("tags"))).select("id")
    within = items.where(has("symbol_fqn", "symbol_signature", "relative_path", "role", "memo")).select(F.col("collection_id").alias("id"))
    return collections.join(own.union(within), "id", "left_semi")


def compact_order(items: DataFrame) -> DataFrame:
    """sort_order as 0..n-1 in each collection, by the old order and id."""
    w = Window.partitionBy("collection_id").orderBy("sort_order", "id")
    return items.withColumn("sort_order", (F.row_number().over(w) - 1).cast("bigint"))


def remove_item(items: DataFrame, item_id: int) -> DataFrame:
    return compact_order(items.where(F.col("id") != item_id))


def reorder_items(items: DataFrame, orders: DataFrame) -> DataFrame:
    """orders: (collection_id, ids). The items of each collection in the order of ids.

    A collection whose ids repeat, lack an item or hold a foreign one keeps its order; column valid tells."""
    have = items.groupBy("collection_id").agg(F.array_sort(F.collect_list("id")).alias("have"))
    valid = orders.join(have, "collection_id").where(F.array_sort("ids") == F.col("have"))
    asked = valid.select("collection_id", F.posexplode("ids").alias("place", "id"))
    met = items.join(asked, ["collection_id", "id"], "left")
    ok = F.col("place").isNotNull()
    return met.withColumn("sort_order", F.when(ok, F.col("place").cast("bigint")).otherwise(F.col("sort_order"))).withColumn("valid", ok).select(*items.columns, "valid")


def neighbour_swap(items: DataFrame, item_id: int, step: int) -> DataFrame:
    """(collection_id, ids): the order with one item moved a place up (-1) or down (1)."""
    places = compact_order(items).withColumn("moved", F.col("id") == item_id)
    w = Window.partitionBy("collection_id").orderBy("sort_order")
    other = F.lead if step < 0 else F.lag
    shift = F.when(F.col("moved"), F.lit(step)).when(other("moved", 1, False).over(w), F.lit(-step)).otherwise(0)
    n = F.count("*").over(Window.partitionBy("collection_id"))
    to = places.withColumn("to", F.greatest(F.lit(0), F.least(n - 1, F.col("sort_order") + shift)))
    return to.groupBy("collection_id").agg(F.array_sort(F.collect_list(F.struct("to", F.col("moved") == F.lit(step > 0), "id"))).alias("s")).select("collection_id", F.col("s.id").alias("ids"))


def next_ordinal(items: DataFrame) -> DataFrame:
    return items.groupBy("collection_id").agg((F.coalesce(F.max("sort_order"), F.lit(-1)) + 1).alias("next_order"))


def new_items(items: DataFrame, new: DataFrame, top: int | None = None) -> DataFrame:
    """The rows of `new` (its columns less id and sort_order) that duplicate no (collection, fqn, signature, path), with
    ids that go on from `top`, the largest so far, and places that go on in their collections."""
    key = ["collection_id", "symbol_fqn", "symbol_signature", "relative_path"]
    top = items.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] if top is None else top
    fresh = new.dropDuplicates(key).join(items, key, "left_anti").join(next_ordinal(items), "collection_id", "left")
    # one numbering gives both: places within a collection are those of all, less the collection's first
    dealt = placed(lambda: [F.col(c) for c in key], fresh)
    first = dealt.groupBy("collection_id").agg(F.min("place").alias("_first"))
    met = dealt.join(first, "collection_id").withColumn("id", (F.lit(top) + F.col("place")).cast("bigint"))
    met = met.withColumn("sort_order", (F.coalesce("next_order", F.lit(0)) + F.col("place") - F.col("_first")).cast("bigint"))
    return met.select(*[(F.col(f.name) if f.name in met.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in items.schema.fields])


def add_items(items: DataFrame, new: DataFrame) -> DataFrame:
    """items with the new ones."""
    return items.unionByName(new_items(items, new))


def mark_reviewed(items: DataFrame, symbols: DataFrame, item_id: int) -> DataFrame:
    """The item's capture is renewed from its current symbol; one that isn't linked to a live symbol is left as it is."""
    now = symbols.groupBy("repository_id", "symbol_id").agg(F.min(F.struct("ast_fingerprint", "relative_path", "start_line", "end_line")).alias("now"))
    met = items.join(now, ["repository_id", "symbol_id"], "left")
    hit = (F.col("id") == item_id) & (F.col("status") == "linked") & F.col("now").isNotNull()
    fresh = {c: F.col(f"now.{c}") for c in ("ast_fingerprint", "relative_path", "start_line", "end_line")} | {"reviewed_at": F.current_timestamp()}
    return met.select(*[F.when(hit, fresh[c]).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c) for c in items.columns])


def relink_item(items: DataFrame, symbols: DataFrame, item_id: int, symbol_id: str) -> DataFrame:
    """The item is tied to a symbol and captures it, unless another linked item of its collection has that symbol."""
    taken = items.where((F.col("status") == "linked") & (F.col("symbol_id") == symbol_id) & (F.col("id") != item_id)).select("collection_id").distinct().withColumn("taken", F.lit(True))
    now = symbols.where(F.col("symbol_id") == symbol_id).groupBy("repository_id").agg(F.min(F.struct("symbol_id", "fqn", "signature", "relative_path", "start_line", "end_line", "ast_fingerprint")).alias("now"))
    met = items.join(taken, "collection_id", "left").join(now, "repository_id", "left")
    hit = (F.col("id") == item_id) & F.col("taken").isNull() & F.col("now").isNotNull()
    fresh = {"symbol_id": "symbol_id", "symbol_fqn": "fqn", "symbol_signature": "signature", "relative_path": "relative_path", "start_line": "start_line", "end_line": "end_line", "ast_fingerprint": "ast_fingerprint"}
    values = {c: F.col(f"now.{f}") for c, f in fresh.items()} | {"status": F.lit("linked")}
    return met.select(*[F.when(hit, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in items.columns])


def delete_collections(collections: DataFrame, items: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the collections in ids (column id); items go with them."""
    return collections.join(ids, "id", "left_anti"), items.join(ids.select(F.col("id").alias("collection_id")), "collection_id", "left_anti").select(*items.columns)


def newest(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("r = 1").drop("r")


def newest_note(notes: DataFrame) -> DataFrame:
    """Each symbol's linked note that was updated last; of equals the larger id."""
    return newest(notes.where("status = 'linked'"), ["repository_id", "symbol_id"], [F.desc("updated_at"), F.desc("id")])


def overlay_drafts(notes: DataFrame, drafts: DataFrame) -> DataFrame:
    """Notes with the title, body and tags of a draft for the same id and symbol, where there is one."""
    d = drafts.select(F.col("id"), F.col("symbol_id"), F.struct("title", "body_markdown", "tags").alias("d"))
    met = notes.join(d, ["id", "symbol_id"], "left")
    return met.select(*[F.when(F.col("d").isNotNull(), F.col(f"d.{c}")).otherwise(F.col(c)).alias(c) if c in ("title", "body_markdown", "tags") else F.col(c) for c in notes.columns])


def upsert_repositories(old: DataFrame, new: DataFrame) -> DataFrame:
    """By root path: a known one keeps its id and created_at and takes the rest from `new`."""
    o, n = old.alias("o"), new.alias("n")
    met = o.join(n, F.col("o.root_path") == F.col("n.root_path"), "full_outer")
    pick = lambda c: F.coalesce(f"o.{c}", f"n.{c}") if c in ("id", "created_at", "root_path") else F.when(F.col("n.root_path").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    return met.select(*[pick(c).alias(c) for c in old.columns])


def snapshot_statuses(log: DataFrame) -> DataFrame:
    """Status from an append-only log of valid snapshots: the newest is current, the one before previous_valid."""
    w = Window.partitionBy("repository_id").orderBy(F.desc("snapshot_id"))
    return log.withColumn("r", F.row_number().over(w)).where("r <= 2").withColumn("status", F.when(F.col("r") == 1, "current").otherwise("previous_valid")).drop("r")


def valid_snapshot(version: int, state: str = "state_json") -> Column:
    """A JSON object, a supported schema version, and texts that aren't blank."""
    kind = F.schema_of_variant(F.try_parse_json(F.col(state)))
    return F.coalesce(kind.startswith("OBJECT") & F.col("schema_version").between(1, version) & (F.trim("app_version") != "") & (F.trim("repository_id") != "") & (F.col("database_format_version") >= 1), F.lit(False))


def restoration_flags(requests: DataFrame, repositories: DataFrame, runs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Six flags a request, each valid or reconfirmation_required.

    requests: request_id, repository_id, root_path, branch, head, revision, symbol_id, fqn, signature, relative_path,
    start_line, end_line. repositories: as stored, with the inspected branch, head and is_dirty."""
    latest = runs.where(F.col("status").isin("completed", "partial") & F.col("completed_at").isNotNull()).groupBy("repository_id").agg(F.max_by("revision", "id").alias("last_revision"))
    repo = repositories.select(F.col("id").alias("repository_id"), F.struct("root_path", "branch", "head", "is_dirty").alias("repo"))
    exact = symbols.select("repository_id", "symbol_id", "fqn", "signature", "relative_path", "start_line", "end_line").distinct().withColumn("exact", F.lit(True))
    met = requests.join(repo, "repository_id", "left").join(latest, "repository_id", "left").join(exact, ["repository_id", "symbol_id", "fqn", "signature", "relative_path", "start_line", "end_line"], "left")
    known = F.coalesce(F.col("repo.root_path") == F.col("root_path"), F.lit(False))
    revision = known & F.coalesce((F.col("repo.branch") == F.col("branch")) & (F.col("repo.head") == F.col("head")) & ~F.col("repo.is_dirty"), F.lit(False))
    analysis = revision & F.coalesce(F.col("last_revision") == F.col("revision"), F.lit(False))
    symbol = known & (F.col("symbol_id").isNull() | (analysis & F.coalesce("exact", F.lit(False))))
    flag = lambda c, n: F.when(c, "valid").otherwise("reconfirmation_required").alias(n)
    return met.select("request_id", flag(known, "repository"), flag(revision, "git_revision"), flag(analysis, "analysis"), flag(symbol, "symbol"), flag(symbol, "file"), flag(symbol, "lines"))


def owner_groups(symbols: DataFrame) -> DataFrame:
    """(repository_id, language, relative_path, owner, members): symbols by owner within a file, members by line and id."""
    owner = F.regexp_extract("fqn", r"(?s)^(.*)\.[^.]*$", 1)
    w = symbols.withColumn("owner", owner)
    return w.groupBy("repository_id", "language", "relative_path", "owner").agg(F.array_sort(F.collect_list(F.struct("start_line", "symbol_id"))).alias("m")).select("repository_id", "language", "relative_path", "owner", F.col("m.symbol_id").alias("members"))
