"""Call resolution: one edge a call, with a verdict, from equi joins on pre-aggregated symbols.

The verdict needs the number of candidates and, of a single one, its id. Symbols are therefore aggregated by each
candidate key to (count, least id) before any join, so a name that many symbols bear never multiplies calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import is_self_reference, lookup_name, owner_name, parent_scope, resolve_module, simple_name, strip_module_suffix
from ..sources.staged import staged


def _counted(symbols: DataFrame, keys: list[str], name: str) -> DataFrame:
    return symbols.groupBy(*keys).agg(F.count("*").alias(f"{name}_n"), F.min("symbol_id").alias(f"{name}_id"))


def resolve_calls(symbols: DataFrame, calls: DataFrame, keep: tuple[str, ...] = ("call_seq",), web: bool = False, traced: bool = False) -> DataFrame:
    """(keep.., caller_symbol_id, callee_symbol_id, unresolved_name, confidence, source_line), one row a call.

    traced: instead all columns of the call, the verdict, and `via`, by what it came about (see resolve_changes).

    Candidates: by receiver type if the call has one (narrowed to the imported module if that leaves any, and with no
    fallback); else in the caller's scope; else in its file, for unqualified calls; else anywhere in its language. One
    candidate is resolved if the call has a receiver type, is unqualified or refers to itself; none is unresolved;
    all else is ambiguous. web: no receiver types, and a single candidate is resolved however the call is written.
    A caller that isn't among the symbols has no scope and no file. All of it happens within a call's repository."""
    s = symbols.select("repository_id", "symbol_id", "language", "relative_path", lookup_name(F.col("language"), simple_name(F.col("fqn"))).alias("name"), parent_scope(F.col("fqn")).alias("scope"), owner_name(F.col("fqn")).alias("owner"), "fqn")
    callers = s.groupBy("repository_id", F.col("symbol_id").alias("caller_symbol_id")).agg(F.min(F.struct("scope", "relative_path")).alias("at"))
    c = calls.join(callers, ["repository_id", "caller_symbol_id"], "left")
    c = c.withColumn("name", lookup_name(F.col("language"), F.col("target_name"))).withColumn("scope", F.col("at.scope")).withColumn("relative_path", F.col("at.relative_path"))
    for keys, kind in ((["repository_id", "language", "scope", "name"], "scope"), (["repository_id", "language", "relative_path", "name"], "file"), (["repository_id", "language", "name"], "all")):
        c = c.join(_counted(s, keys, kind), keys, "left")
    n = lambda kind: F.coalesce(F.col(f"{kind}_n"), F.lit(0))
    typed = F.lit(False)
    if not web:
        typed = F.col("receiver_type").isNotNull()
        owned = s.withColumnRenamed("owner", "receiver_type")
        c = c.join(_counted(owned, ["repository_id", "language", "receiver_type", "name"], "typed"), ["repository_id", "language", "receiver_type", "name"], "left")
        modules = _modules(owned)
        c = c.withColumn("module", resolve_module(F.col("relative_path"), F.col("receiver_module")))
        c = c.join(_counted(modules, ["repository_id", "language", "receiver_type", "name", "module"], "imported"), ["repository_id", "language", "receiver_type", "name", "module"], "left")
    in_file = (n("file") > 0) & ~F.col("is_qualified")

    def pick(what: str) -> Column:
        own = F.when(n("scope") > 0, F.col(f"scope_{what}")).when(in_file, F.col(f"file_{what}")).otherwise(F.col(f"all_{what}"))
        if web:
            return own
        return F.when(typed, F.when(n("imported") > 0, F.col(f"imported_{what}")).otherwise(F.col(f"typed_{what}"))).otherwise(own)

    count = F.coalesce(pick("n"), F.lit(0))
    sure = F.lit(True) if web else typed | ~F.col("is_qualified") | is_self_reference(F.col("display_target"))
    confidence = F.when((count == 1) & sure, "resolved").when(count == 0, "unresolved").otherwise("ambiguous")
    out = c.withColumn("confidence", confidence).withColumn("picked", pick("id"))
    hit = F.col("confidence") == "resolved"
    if traced:
        own = F.when(n("scope") > 0, "scope").when(in_file, "file").otherwise("all")
        basis = F.when(typed, F.when(n("imported") > 0, "imported").otherwise("typed")).otherwise(own)
        via = F.struct(basis.alias("basis"), "name", "scope", "relative_path", "module")
        return out.select(*calls.columns, F.when(hit, F.col("picked")).alias("callee_symbol_id"), F.when(~hit, F.col("display_target")).alias("unresolved_name"), "confidence", via.alias("via"))
    return out.select(*keep, "caller_symbol_id", F.when(hit, F.col("picked")).alias("callee_symbol_id"), F.when(~hit, F.col("display_target")).alias("unresolved_name"), "confidence", "source_line")


#: What of a symbol a verdict can depend on.
_FACTS = ["repository_id", "symbol_id", "language", "fqn", "relative_path"]


def _modules(symbols: DataFrame) -> DataFrame:
    at = strip_module_suffix(F.col("relative_path"))
    return symbols.withColumn("module", F.explode(F.array_distinct(F.array(at, F.regexp_replace(at, "/index$", "")))))


def touched_symbols(old: DataFrame, new: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The symbols that stand in one revision alone, or in both with another name or path, with their candidate keys.

    files: (repository_id, relative_path) of the files that differ, as impact.diff_files gives them; then no other
    file's symbols are compared."""
    if files is not None:
        old, new = (s.join(files, ["repository_id", "relative_path"], "left_semi") for s in (old, new))
    count = old.select(*_FACTS, F.lit(-1).alias("by")).union(new.select(*_FACTS, F.lit(1).alias("by"))).groupBy(*_FACTS).agg(F.sum("by").alias("by"))
    return count.where("by <> 0").select(*_FACTS, lookup_name(F.col("language"), simple_name(F.col("fqn"))).alias("name"), parent_scope(F.col("fqn")).alias("scope"), owner_name(F.col("fqn")).alias("receiver_type"))


def to_resolve_again(edges: DataFrame, touched: DataFrame) -> DataFrame:
    """Traced edges with column `again`: whether the touched symbols can change the verdict.

    They can if the caller is touched, or a candidate key that the verdict rests on, or one that goes before it. A call
    that its scope decides doesn't care for symbols of its name elsewhere."""
    e = edges.withColumns({f"_{c}": F.col(f"via.{c}") for c in ("basis", "name", "scope", "relative_path", "module")})
    lang = ["repository_id", "language", "name"]
    keys = {"scope": (touched, [*lang, "scope"]), "file": (touched, [*lang, "relative_path"]), "all": (touched, lang), "typed": (touched, [*lang, "receiver_type"]), "imported": (_modules(touched), [*lang, "receiver_type", "module"]), "caller": (touched, ["repository_id", "symbol_id"])}
    there = {"name": "_name", "scope": "_scope", "relative_path": "_relative_path", "module": "_module", "symbol_id": "caller_symbol_id"}
    for kind, (rows, names) in keys.items():
        own = rows.select(*[F.col(c).alias(there.get(c, c)) for c in names]).distinct().withColumn(f"_hit_{kind}", F.lit(True))
        e = e.join(own, [there.get(c, c) for c in names], "left")
    hit = lambda kind: F.coalesce(F.col(f"_hit_{kind}"), F.lit(False))
    basis, typed = F.col("_basis"), F.col("receiver_type").isNotNull()
    plain = hit("scope") | (~F.col("is_qualified") & (basis != "scope") & hit("file")) | ((basis == "all") & hit("all"))
    of_type = hit("imported") | ((basis == "typed") & hit("typed"))
    return e.select(*edges.columns, F.coalesce(hit("caller") | F.when(typed, of_type).otherwise(plain), F.lit(True)).alias("again"))


def resolve_changes(edges: DataFrame, old: DataFrame, new: DataFrame, files: DataFrame | None = None, replaced: DataFrame | None = None, fresh: DataFrame | None = None) -> DataFrame:
    """The traced edges of a new revision out of those of the old one: as resolve_calls would give for all of its calls.

    old, new: symbols of the two revisions; files: see touched_symbols. replaced: (repository_id, caller_symbol_id) of the
    callers whose calls go; fresh: the calls that come. Edges that nothing touched are carried over by joins with the
    touched keys alone; the others and the fresh calls are resolved against the symbols of their names."""
    touched = staged(touched_symbols(old, new, files), "touched")
    left = edges if replaced is None else edges.join(replaced.select("repository_id", "caller_symbol_id"), ["repository_id", "caller_symbol_id"], "left_anti").select(*edges.columns)
    judged = to_resolve_again(left, touched)
    call = [c for c in edges.columns if c not in ("callee_symbol_id", "unresolved_name", "confidence", "via")]
    due = judged.where("again").select(*call)
    due = staged(due if fresh is None else due.unionByName(fresh.select(*call)), "due")
    names = due.select("repository_id", "language", lookup_name(F.col("language"), F.col("target_name")).alias("_name")).distinct().withColumn("_named", F.lit(True))
    by = due.select("repository_id", F.col("caller_symbol_id").alias("symbol_id")).distinct().withColumn("_calls", F.lit(True))
    near = new.withColumn("_name", lookup_name(F.col("language"), simple_name(F.col("fqn")))).join(names, ["repository_id", "language", "_name"], "left").join(by, ["repository_id", "symbol_id"], "left")
    near = near.where("_named or _calls").select(*new.columns)
    return judged.where(~F.col("again")).drop("again").unionByName(resolve_calls(near, due, traced=True))


def analysis_summary(edges: DataFrame, symbols: DataFrame, files: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """One row: counts of the run and its status, partial if there is any diagnostic."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    met = one(files, "files").join(one(symbols, "symbols")).join(one(edges, "edges")).join(one(diagnostics, "diagnostics"))
    return met.withColumn("status", F.when(F.col("diagnostics") > 0, "partial").otherwise("completed"))
