"""Changes of notes, collections and items as whole new tables: requests in, rows out.

Requests are DataFrames, so many are done at once. `now` is the time to write, the current one by default. A request that a single
call would refuse (no such symbol, not exactly one row) does nothing here; the second result of a function, where there
is one, holds the refused requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import DEFAULT_NOTE
from ..functions.names import clean_tags, clean_title
from .impact import latest_run
from ..sources.staged import staged
from .lifecycle import next_ordinal
from .orders import placed

_NOW = F.current_timestamp


def _placed(rows: DataFrame, top: int, order: list[str]) -> DataFrame:
    """rows with ids that go on from the largest known one, in a total order; dealt by ranges, over all tasks."""
    return placed(lambda: [F.col(c) for c in order], rows).withColumn("id", (F.lit(top) + F.col("place")).cast("bigint")).drop("place")


def _top(known: DataFrame, top: int | None) -> int:
    return known.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] if top is None else top


def _captured(asked: DataFrame, symbols: DataFrame) -> DataFrame:
    """Requests with the symbol they name, by repository and id, as struct now; those without one go."""
    whole = F.min(F.struct("fqn", "signature", "relative_path", "start_line", "end_line", "ast_fingerprint")).alias("now")
    return asked.join(symbols.groupBy("repository_id", "symbol_id").agg(whole), ["repository_id", "symbol_id"])


def new_notes(notes: DataFrame, symbols: DataFrame, asked: DataFrame, now: Column | None = None, top: int | None = None) -> DataFrame:
    """The new note of each request (repository_id, symbol_id, title) whose symbol is there: linked, empty body.

    top: the largest id so far, if known. The search text (see search_rows) is the symbol's name and the title."""
    at = _NOW() if now is None else now
    new = _captured(asked, symbols).select("repository_id", "symbol_id", F.col("now.fqn").alias("symbol_fqn"), F.col("now.signature").alias("symbol_signature"), "title", F.lit("").alias("body_markdown"), F.array().cast("array<string>").alias("tags"), F.lit("linked").alias("status"), at.alias("created_at"), at.alias("updated_at"))
    new = _placed(new, _top(notes, top), ["repository_id", "symbol_id", "title"])
    return new.select(*[(F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in notes.schema.fields])


def create_notes(notes: DataFrame, symbols: DataFrame, asked: DataFrame, now: Column | None = None) -> DataFrame:
    """notes with the new ones."""
    return notes.unionByName(new_notes(notes, symbols, asked, now))


def update_notes(notes: DataFrame, symbols: DataFrame, asked: DataFrame, now: Column | None = None) -> DataFrame:
    """notes after requests (repository_id, symbol_id, id, title, body_markdown, tags): text taken over, name captured anew, linked.

    A request must name the note by all three ids, and its symbol must be there."""
    key = ["repository_id", "symbol_id", "id"]
    fresh = _captured(asked, symbols).groupBy(*key).agg(F.max(F.struct("title", "body_markdown", "tags", F.col("now.fqn").alias("fqn"), F.col("now.signature").alias("signature"))).alias("new"))
    met = notes.join(fresh, key, "left")
    values = {"title": "new.title", "body_markdown": "new.body_markdown", "tags": "new.tags", "symbol_fqn": "new.fqn", "symbol_signature": "new.signature"}
    done = {c: F.col(v) for c, v in values.items()} | {"status": F.lit("linked"), "updated_at": _NOW() if now is None else now}
    hit = F.col("new").isNotNull()
    return met.select(*[F.when(hit, done[c]).otherwise(F.col(c)).alias(c) if c in done else F.col(c) for c in notes.columns])


def saved_notes(notes: DataFrame, symbols: DataFrame, asked: DataFrame, now: Column | None = None, top: int | None = None) -> DataFrame:
    """The older way to write: each request (repository_id, symbol_id, body_markdown, tags) goes to its symbol's newest
    linked note, or to a new one with the default title; the title stays. What comes out is the notes so written."""
    key = ["repository_id", "symbol_id"]
    newest = notes.where("status = 'linked'").groupBy(*key).agg(F.max(F.struct("updated_at", "id", "title")).alias("old")).select(*key, "old.id", "old.title")
    without = asked.join(newest, key, "left_anti").select(*key, F.lit(DEFAULT_NOTE).alias("title")).distinct()
    made = new_notes(notes, symbols, without, now, top)
    old = notes.join(newest.join(asked.select(*key).distinct(), key, "left_semi").select("id"), "id", "left_semi").select(*notes.columns)
    aims = newest.unionByName(made.select(*key, "id", "title"))
    return update_notes(old.unionByName(made), symbols, asked.join(aims, key), now)


def save_notes(notes: DataFrame, symbols: DataFrame, asked: DataFrame, now: Column | None = None) -> DataFrame:
    """notes with those that saved_notes writes."""
    done = staged(saved_notes(notes, symbols, asked, now), "saved")
    return notes.join(done.select("id"), "id", "left_anti").select(*notes.columns).unionByName(done)


def search_rows(notes: DataFrame) -> DataFrame:
    """(repository_id, entity_type, entity_id, title, content): what the notes' full-text index holds."""
    return notes.select("repository_id", F.lit("note").alias("entity_type"), F.col("id").cast("string").alias("entity_id"), F.concat_ws(" ", "symbol_fqn", "title").alias("title"), F.col("body_markdown").alias("content"))


def collection_revisions(repositories: DataFrame, runs: DataFrame) -> DataFrame:
    """(repository_id, revision): that of the newest committed run, else the repository's head, else empty."""
    done = latest_run(runs).select("repository_id", "revision")
    met = repositories.select(F.col("id").alias("repository_id"), "head").join(done, "repository_id", "left")
    return met.select("repository_id", F.coalesce("revision", "head", F.lit("")).alias("revision"))


def new_collections(collections: DataFrame, repositories: DataFrame, runs: DataFrame, asked: DataFrame, now: Column | None = None, top: int | None = None) -> DataFrame:
    """The new collection of each request (repository_id, title, overview_markdown, tags) of a known repository."""
    at = _NOW() if now is None else now
    new = require_repositories(asked, repositories).join(collection_revisions(repositories, runs), "repository_id")
    new = new.select("repository_id", clean_title(F.col("title"), UNTITLED).alias("title"), "overview_markdown", clean_tags(F.col("tags")).alias("tags"), F.col("revision").alias("created_revision"), at.alias("created_at"), at.alias("updated_at"))
    new = _placed(new, _top(collections, top), ["repository_id", "title", "overview_markdown"])
    return new.select(*[(F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in collections.schema.fields])


def create_collections(collections: DataFrame, repositories: DataFrame, runs: DataFrame, asked: DataFrame, now: Column | None = None) -> DataFrame:
    """collections with the new ones."""
    return collections.unionByName(new_collections(collections, repositories, runs, asked, now))


#: Title of a collection that is given none (fixed value).
UNTITLED = "새 컬렉션"


def update_collections(collections: DataFrame, asked: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """collections after requests (repository_id, id, title, overview_markdown, tags), and the requests that name none."""
    key = ["repository_id", "id"]
    new = asked.groupBy(*key).agg(F.max(F.struct("title", "overview_markdown", "tags")).alias("new"))
    met = collections.join(new, key, "left")
    done = {"title": clean_title(F.col("new.title"), UNTITLED), "overview_markdown": F.col("new.overview_markdown"), "tags": clean_tags(F.col("new.tags")), "updated_at": _NOW() if now is None else now}
    hit = F.col("new").isNotNull()
    out = met.select(*[F.when(hit, done[c]).otherwise(F.col(c)).alias(c) if c in done else F.col(c) for c in collections.columns])
    return out, asked.join(collections.select(*key), key, "left_anti")


def update_items(items: DataFrame, asked: DataFrame, now: Column | None = None) -> DataFrame:
    """items after requests (repository_id, collection_id, id, role, memo): role without outer spaces, memo as it is."""
    key = ["repository_id", "collection_id", "id"]
    new = asked.groupBy(*key).agg(F.max(F.struct("role", "memo")).alias("new"))
    hit = F.col("new").isNotNull()
    done = {"role": F.trim("new.role"), "memo": F.col("new.memo"), "updated_at": _NOW() if now is None else now}
    return items.join(new, key, "left").select(*[F.when(hit, done[c]).otherwise(F.col(c)).alias(c) if c in done else F.col(c) for c in items.columns])


def touch_collections(collections: DataFrame, ids: DataFrame, now: Column | None = None) -> DataFrame:
    """collections with updated_at set for those in ids (column id)."""
    met = collections.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return met.withColumn("updated_at", F.when(F.col("_hit"), _NOW() if now is None else now).otherwise(F.col("updated_at"))).select(*collections.columns)


def require_repositories(asked: DataFrame, repositories: DataFrame) -> DataFrame:
    """The requests whose repository is known."""
    return asked.join(repositories.select(F.col("id").alias("repository_id")).distinct(), "repository_id", "left_semi")


def require_collections(asked: DataFrame, collections: DataFrame) -> DataFrame:
    """The requests whose collection belongs to their repository."""
    own = collections.select("repository_id", F.col("id").alias("collection_id")).distinct()
    return asked.join(own, ["repository_id", "collection_id"], "left_semi")


def linked_item_of(items: DataFrame, symbols: DataFrame) -> DataFrame:
    """(collection_id, symbol_id): which symbols a collection has: by id, or by captured name, signature and path."""
    linked = items.where("status = 'linked'")
    by_id = linked.where("symbol_id is not null").select("repository_id", "collection_id", "symbol_id").join(symbols.select("repository_id", "symbol_id"), ["repository_id", "symbol_id"], "left_semi")
    names = symbols.select("repository_id", F.col("symbol_id").alias("own"), F.col("fqn").alias("symbol_fqn"), F.col("signature").alias("symbol_signature"), "relative_path")
    by_name = linked.select("repository_id", "collection_id", "symbol_fqn", "symbol_signature", "relative_path").join(names, ["repository_id", "symbol_fqn", "symbol_signature", "relative_path"])
    return by_id.select("collection_id", "symbol_id").union(by_name.select("collection_id", F.col("own"))).distinct()


def restored_symbols(wanted: DataFrame, symbols: DataFrame) -> DataFrame:
    """(request_id, symbol_id) of wanted (request_id, repository_id, symbol_id, fqn, signature): by id, else the least
    id of the name and signature, else null."""
    by_id = symbols.select("repository_id", "symbol_id", F.col("symbol_id").alias("a")).distinct()
    by_name = symbols.groupBy("repository_id", "fqn", "signature").agg(F.min("symbol_id").alias("b"))
    met = wanted.join(by_id, ["repository_id", "symbol_id"], "left").join(by_name, ["repository_id", "fqn", "signature"], "left")
    return met.select("request_id", F.coalesce("a", "b").alias("symbol_id"))


def legacy_notes(notes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Notes of an older table, with what it lacks: a default title, linked status, and names from their symbols.

    A captured name that is there stays; of a symbol that is gone the name is 'unknown'."""
    old = {c.name: c for c in notes.schema.fields}
    fill = {"symbol_fqn": F.lit(""), "symbol_signature": F.lit(""), "status": F.lit("linked"), "title": F.lit(DEFAULT_NOTE), "body_markdown": F.lit(""), "tags": F.array().cast("array<string>")}
    whole = notes.select("*", *[v.alias(c) for c, v in fill.items() if c not in old])
    now = symbols.groupBy("symbol_id").agg(F.min(F.struct("fqn", "signature")).alias("_now"))
    met = whole.join(now, "symbol_id", "left")
    met = met.withColumn("symbol_fqn", F.coalesce(F.nullif("symbol_fqn", F.lit("")), "_now.fqn", F.lit("unknown")))
    return met.withColumn("symbol_signature", F.coalesce(F.nullif("symbol_signature", F.lit("")), "_now.signature", F.lit(""))).select(*whole.columns)


def widened_symbols(symbols: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Symbols of an older table in the present schema (column to type); what it lacks is null."""
    return symbols.select(*[(F.col(c) if c in symbols.columns else F.lit(None)).cast(kind).alias(c) for c, kind in schema.items()])


# the variant that runs in a browser: one note a symbol, items by symbol id alone


def web_relinked(items: DataFrame, symbols: DataFrame, repository_id: str) -> DataFrame:
    """Items linked if their symbol stands in the open repository, by id alone; others, and other repositories', are orphans."""
    now = symbols.where(F.col("repository_id") == repository_id).groupBy("repository_id", "symbol_id").agg(F.min("ast_fingerprint").alias("_print"))
    met = items.join(now, ["repository_id", "symbol_id"], "left")
    alive = F.col("_print").isNotNull()
    return met.withColumn("status", F.when(alive, "linked").otherwise("orphan")).withColumn("is_changed", F.coalesce(F.col("_print") != F.col("ast_fingerprint"), F.lit(False))).select(*[c for c in items.columns if c != "is_changed"], "is_changed")


def web_create_notes(notes: DataFrame, symbols: DataFrame, asked: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """As create_notes, but a symbol that has a note is refused; of several requests for one symbol the first by title is done."""
    key = ["repository_id", "symbol_id"]
    first = asked.groupBy(*key).agg(F.min("title").alias("title"))
    fresh = first.join(notes.select(*key).distinct(), key, "left_anti")
    return create_notes(notes, symbols, fresh, now), asked.join(notes.select(*key).distinct(), key, "left_semi")


def web_update_items(items: DataFrame, asked: DataFrame, now: Column | None = None) -> DataFrame:
    """As update_items, but an empty role, and a memo that is null, leave what is there."""
    key = ["repository_id", "collection_id", "id"]
    kept = asked.select(*key, F.nullif(F.trim(F.col("role")), F.lit("")).alias("r"), F.col("memo").alias("m")).join(items.select(*key, "role", "memo"), key)
    return update_items(items, kept.select(*key, F.coalesce("r", "role").alias("role"), F.coalesce("m", "memo").alias("memo")), now)


def web_add_items(items: DataFrame, symbols: DataFrame, asked: DataFrame, now: Column | None = None) -> DataFrame:
    """items with each request (repository_id, collection_id, symbol_id, role, memo) that names a symbol the collection lacks, by id."""
    key = ["repository_id", "collection_id", "symbol_id"]
    first = asked.groupBy(*key).agg(F.min(F.struct("role", "memo")).alias("t")).select(*key, "t.role", "t.memo")
    fresh = _captured(first.join(items.select(*key), key, "left_anti"), symbols).join(next_ordinal(items), "collection_id", "left")
    place = F.row_number().over(Window.partitionBy("collection_id").orderBy("symbol_id")) - 1 + F.coalesce("next_order", F.lit(0))
    at = _NOW() if now is None else now
    new = fresh.select(*key, F.col("now.fqn").alias("symbol_fqn"), F.col("now.signature").alias("symbol_signature"), "now.relative_path", "now.start_line", "now.end_line", "now.ast_fingerprint", "role", "memo", F.lit("linked").alias("status"), place.cast("bigint").alias("sort_order"), at.alias("created_at"), at.alias("updated_at"))
    new = _placed(new, _top(items, None), ["collection_id", "symbol_id"])
    return items.unionByName(new.select(*[c for c in new.columns if c in items.columns]), allowMissingColumns=True)


def web_repository(files: DataFrame, repository_id: str, name: str, hashed: Column, known: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """The record of a folder opened in a browser; head is a hash of its files' paths and hashes, in order of path.

    hashed: hash of a file's text. known: the record so far, whose created_at stays."""
    from ..functions.hashing import fnv32

    listed = F.array_sort(F.collect_list(F.struct("relative_path", hashed.alias("h"))))
    head = files.agg(fnv32(F.array_join(F.transform(listed, lambda f: F.concat(f["relative_path"], F.lit(":"), f["h"])), "|")).alias("head"))
    at = _NOW() if now is None else now
    row = head.select(F.lit(repository_id).alias("id"), F.lit(name).alias("root_path"), F.lit(name).alias("display_name"), F.lit("browser").alias("branch"), "head", F.lit(False).alias("is_dirty"), at.alias("updated_at"))
    if known is None:
        return row.withColumn("created_at", at)
    old = known.where(F.col("id") == repository_id).agg(F.min("created_at").alias("created_at"))
    return row.join(F.broadcast(old)).withColumn("created_at", F.coalesce("created_at", at))


def filter_language(symbols: DataFrame, language: str) -> DataFrame:
    """The symbols of a language; 'all' is all of them."""
    return symbols if language == "all" else symbols.where(F.col("language") == language)


def quick_filter(collections: DataFrame, text: str) -> DataFrame:
    """Collections whose title or tags hold the text in any case; a blank text holds for all."""
    words = F.lower(F.concat_ws(" ", "title", F.array_join("tags", " ")))
    return collections.where(F.contains(words, F.lit(text.strip().lower())))
