"""Notes and collections as HTML and text. A body's Markdown goes through an Arrow UDF, all else is built in.

Bodies are rendered row by row; sections and collections are put together by aggregation, in order of their items.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import labels, markdown, syntax
from ..functions.names import escape_html
from .lifecycle import item_details

# What an export says of an item.
ROLE, PLACE, STATE, NO_TAGS = "역할", "위치", "상태", "없음"
CHANGED, LOST = "분석 이후 코드 변경 확인 필요", "연결 필요"

_TEXT, _INT = T.StringType(), T.IntegerType()
_BODY = T.StructType([T.StructField("html", _TEXT), T.StructField("text", _TEXT), T.StructField("resolved", _INT), T.StructField("unresolved", _INT)])
_RANGE = T.StructType([T.StructField("first", _INT), T.StructField("last", _INT)])
_TOKENS = T.ArrayType(T.ArrayType(T.StructType([T.StructField("text", _TEXT), T.StructField("kind", _TEXT)])))


@F.pandas_udf(_BODY)
def _expanded(body: pd.Series, path: pd.Series, source: pd.Series, language: pd.Series) -> pd.DataFrame:
    rows = [markdown.expand(b or "", p, s, g) for b, p, s, g in zip(body, path, source, language, strict=True)]
    return pd.DataFrame(rows, columns=["html", "text", "resolved", "unresolved"])


@F.pandas_udf(_TEXT)
def markdown_html(text: pd.Series) -> pd.Series:
    return text.map(lambda t: markdown.to_html(t or ""))


@F.pandas_udf(_RANGE)
def reference_at(text: pd.Series, offset: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([markdown.reference_at(t or "", o) or (None, None) for t, o in zip(text, offset, strict=True)], columns=["first", "last"]).astype("Int32")


@F.pandas_udf(_TOKENS)
def syntax_tokens(source: pd.Series, language: pd.Series) -> pd.Series:
    return pd.Series([syntax.tokenize(s or "", g) for s, g in zip(source, language, strict=True)])


def _tags(tags: Column) -> Column:
    return F.array_join(F.coalesce(tags, F.array().cast("array<string>")), ", ")


def _strong(label: str) -> str:
    return f"<strong>{label}:</strong> "


def note_exports(notes: DataFrame, symbols: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, html, text, resolved, unresolved) of every note whose symbol is there. sources: (relative_path, source).

    A note whose file has no source keeps its references, counted as unresolved."""
    s = symbols.select("repository_id", "symbol_id", "fqn", "signature", "relative_path", "language")
    met = notes.join(s, ["repository_id", "symbol_id"]).join(sources.select("relative_path", "source"), "relative_path", "left")
    met = met.withColumn("body", _expanded("body_markdown", "relative_path", "source", "language"))
    symbol, tags = F.concat("fqn", "signature"), _tags(F.col("tags"))
    tagged = tags != ""
    html = F.concat(F.lit("<h1>"), escape_html(F.col("title")), F.lit(f"</h1><p><strong>{markdown.FUNCTION}:</strong> <code>"), escape_html(symbol), F.lit(f"</code><br><strong>{markdown.SOURCE}:</strong> "), escape_html(F.col("relative_path")), F.lit("</p>"), F.col("body.html"), F.when(tagged, F.concat(F.lit(f"<p>{_strong(markdown.TAGS)}"), escape_html(tags), F.lit("</p>"))).otherwise(""))
    text = F.concat(F.lit("# "), "title", F.lit(f"\n\n{markdown.FUNCTION}: "), symbol, F.lit(f"\n{markdown.SOURCE}: "), "relative_path", F.lit("\n\n"), F.col("body.text"), F.when(tagged, F.concat(F.lit(f"\n\n{markdown.TAGS}: "), tags)).otherwise(""))
    return met.select("id", html.alias("html"), text.alias("text"), F.col("body.resolved").alias("resolved"), F.col("body.unresolved").alias("unresolved"))


def item_notes(items: DataFrame, notes: DataFrame) -> DataFrame:
    """(item_id, notes): each linked item with the linked notes of its symbol, newest first; none is an empty array."""
    own = notes.where("status = 'linked'").select("repository_id", "symbol_id", "updated_at", F.col("id").alias("note_id"))
    met = items.where("status = 'linked'").select(F.col("id").alias("item_id"), "repository_id", "symbol_id").join(own, ["repository_id", "symbol_id"], "left")
    each = F.sort_array(F.collect_list(F.when(F.col("note_id").isNotNull(), F.struct("updated_at", "note_id"))), asc=False)
    return met.groupBy("item_id").agg(each.alias("n")).select("item_id", F.col("n.note_id").alias("notes"))


def collection_exports(collections: DataFrame, items: DataFrame, symbols: DataFrame, selected: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, html, text, included_notes, resolved, unresolved) of every collection, its items in their order.

    selected: the notes to go with items (item_id, place, title, body_markdown, tags), in order of place. An item without any keeps
    its section. sources: (relative_path, source). References of an item without a symbol or source count as unresolved."""
    detail = item_details(items, symbols).withColumn("symbol", F.col("current_symbol"))
    detail = detail.withColumn("path", F.coalesce("symbol.relative_path", "relative_path")).withColumn("line", F.coalesce("symbol.start_line", "start_line"))
    held = detail.select(F.col("id").alias("item_id"), F.col("symbol.relative_path").alias("relative_path"), F.col("symbol.language").alias("language"))
    bodies = selected.join(held, "item_id").join(sources.select("relative_path", "source"), "relative_path", "left")
    bodies = bodies.withColumn("body", _expanded("body_markdown", "relative_path", "source", "language")).withColumn("t", _tags(F.col("tags")))
    tagged = F.col("t") != ""
    html = F.concat(F.lit("<article><h3>"), escape_html(F.col("title")), F.lit("</h3>"), F.col("body.html"), F.when(tagged, F.concat(F.lit(f"<p>{_strong(markdown.TAGS)}"), escape_html(F.col("t")), F.lit("</p>"))).otherwise(""), F.lit("</article>"))
    text = F.concat_ws("\n\n", F.concat(F.lit("### "), "title"), F.nullif(F.col("body.text"), F.lit("")), F.when(tagged, F.concat(F.lit(f"{markdown.TAGS}: "), F.col("t"))))
    each = F.array_sort(F.collect_list(F.struct("place", html.alias("html"), text.alias("text"))))
    own = bodies.groupBy("item_id").agg(each.alias("own"), F.count("*").alias("n"), F.sum("body.resolved").alias("resolved"), F.sum("body.unresolved").alias("unresolved"))

    met = detail.join(own, detail["id"] == own["item_id"], "left")
    label = labels.item_label(F.col("symbol"), F.col("symbol_fqn"), F.col("symbol_signature"))
    role, memo = labels.role_label(F.col("role")), F.coalesce("memo", F.lit(""))
    place = F.concat("path", F.lit(":"), F.col("line").cast("string"))
    changed, lost = F.col("is_changed"), F.col("status") == "orphan"
    state = F.concat_ws(", ", F.when(changed, CHANGED), F.when(lost, LOST))
    flag = lambda c, what: F.when(c, f"<br>{_strong(STATE)}{what}").otherwise("")
    none = F.array().cast("array<string>")
    head = [escape_html(label), F.lit(f"</h2><p>{_strong(ROLE)}"), escape_html(role), F.lit(f"<br>{_strong(PLACE)}"), escape_html(place), flag(changed, CHANGED), flag(lost, LOST), F.lit("</p>")]
    note = F.when(F.trim(memo) != "", F.concat(F.lit("<p>"), F.replace(escape_html(memo), F.lit("\n"), F.lit("<br>")), F.lit("</p>"))).otherwise("")
    section = F.concat(*head, note, F.array_join(F.coalesce("own.html", none), ""), F.lit("</section>"))
    lines = F.concat_ws("\n\n", label, F.concat(F.lit(f"{ROLE}: "), role), F.concat(F.lit(f"{PLACE}: "), place), F.when(state != "", F.concat(F.lit(f"{STATE}: "), state)), F.nullif(F.trim(memo), F.lit("")), F.nullif(F.array_join(F.coalesce("own.text", none), "\n\n"), F.lit("")))
    rows = met.select("collection_id", F.struct("sort_order", "id", section.alias("html"), lines.alias("text")).alias("row"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("resolved", F.lit(0)).alias("resolved"), F.coalesce("unresolved", F.lit(0)).alias("unresolved"))
    parts = rows.groupBy(F.col("collection_id").alias("id")).agg(F.array_sort(F.collect_list("row")).alias("rows"), *[F.sum(c).alias(c) for c in ("n", "resolved", "unresolved")])
    done = collections.join(parts, "id", "left")
    numbered = lambda field, before: F.transform("rows", lambda r, i: F.concat(F.lit(before), (i + 1).cast("string"), F.lit(". "), r[field]))
    tags = F.coalesce(F.nullif(_tags(F.col("tags")), F.lit("")), F.lit(NO_TAGS))
    overview = F.trim(F.coalesce("overview_markdown", F.lit("")))
    html = F.concat(F.lit("<h1>"), escape_html(F.col("title")), F.lit(f"</h1><p>{_strong(markdown.TAGS)}"), escape_html(tags), F.lit("</p>"), markdown_html(F.coalesce("overview_markdown", F.lit(""))), F.array_join(F.coalesce(numbered("html", "<section><h2>"), none), ""))
    text = F.concat_ws("\n\n", F.concat(F.lit("# "), "title"), F.concat(F.lit(f"{markdown.TAGS}: "), tags), F.nullif(overview, F.lit("")), F.nullif(F.array_join(F.coalesce(numbered("text", "## "), none), "\n\n"), F.lit("")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return done.select("id", html.alias("html"), text.alias("text"), zero("n").alias("included_notes"), zero("resolved").alias("resolved"), zero("unresolved").alias("unresolved"))


def write_exports(exports: DataFrame, path: str) -> None:
    """Exports as files: a folder a row, named by id, with one html and one text row (the text is what stands in for rich text)."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("format"), F.col(k).alias("value")) for k in ("html", "text")]))
    exports.select("id", kinds.alias("x")).select("id", "x.format", "x.value").write.mode("overwrite").partitionBy("id", "format").option("lineSep", "\n").text(path)
