"""Names, paths and texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes and the languages they route to (fixed values).
SUFFIXES = ((".java", "java"), (".php", "php"), (".py", "python"), (".tsx", "typescript"), (".mts", "typescript"), (".cts", "typescript"), (".ts", "typescript"))
#: Directory names that a scan doesn't enter (fixed values).
EXCLUDED_DIRECTORIES = (".git", ".hg", ".svn", "node_modules", "target", "dist", "build", "out", "coverage", ".venv", "venv", "__pycache__", ".next", ".nuxt", ".turbo", ".cache")
#: Beginnings of a call's text that refer to the caller's own type (fixed values).
SELF_PREFIXES = ("self.", "cls.", "this.", "this?.", "super.", "$this->", "self::", "static::", "parent::")


def language_of(path: Column, any_case: bool = False) -> Column:
    """The language a path's suffix stands for; null for others."""
    path, out = F.lower(path) if any_case else path, F.lit(None).cast("string")
    for suffix, language in SUFFIXES:
        out = F.when(path.endswith(suffix), language).otherwise(out)
    return out


def normalize_path(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), "^/+", "")


def is_excluded(path: Column) -> Column:
    return F.arrays_overlap(F.split(normalize_path(path), "/"), F.array(*map(F.lit, EXCLUDED_DIRECTORIES)))


def one_space(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def qualified_name(root: Column, scopes: Column, name: Column, separator: str = ".") -> Column:
    return F.array_join(F.filter(F.concat(F.array(root), scopes, F.array(name)), lambda x: x.isNotNull() & (x != "")), separator)


def parent_scope(fqn: Column) -> Column:
    """What stands before the last dot; empty without one."""
    return F.regexp_extract(fqn, r"(?s)^(.*)\.[^.]*$", 1)


def simple_name(fqn: Column) -> Column:
    return F.substring_index(fqn, ".", -1)


def owner_name(fqn: Column) -> Column:
    return simple_name(parent_scope(fqn))


def php_simple_name(name: Column) -> Column:
    return F.substring_index(name, "\\", -1)


def expression_name(text: Column) -> Column:
    """The last name of an expression, whatever separates its parts."""
    return F.element_at(F.split(F.trim(F.regexp_replace(text, r"[();]", "")), r"[.\\:>\-\s]+"), -1)


def lookup_name(language: Column, name: Column) -> Column:
    """The name as it is compared: PHP folds ASCII case."""
    return F.when(language == "php", F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(name)


def is_self_reference(display: Column) -> Column:
    out = F.lit(False)
    for prefix in SELF_PREFIXES:
        out = out | display.startswith(prefix)
    return F.coalesce(out, F.lit(False))


def strip_module_suffix(path: Column) -> Column:
    """A module path without its source suffix: .ts .tsx .mts .cts (and their .d forms), .js .jsx .mjs .cjs."""
    return F.regexp_replace(path, r"(?:(?:\.d)?\.(?:tsx?|[mc]ts)|\.(?:jsx?|[mc]js))$", "")


def resolve_module(importer: Column, module: Column) -> Column:
    """A relative module against the importing file's folder, with . and .. folded; null if it isn't relative."""
    folder = F.regexp_replace(importer, r"[^/]*$", "")
    parts = F.split(F.concat(folder, module), "/")
    fold = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, p: F.when((p == "") | (p == "."), done).when(p == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(p))),
    )
    return F.when(module.startswith("."), strip_module_suffix(F.array_join(fold, "/")))


def module_name(language: Column, path: Column, namespace: Column) -> Column:
    """A file's module: its Java package or PHP namespace if it has one, else its path with dots.

    Python drops a last __init__, TypeScript a last index."""
    dotted = F.translate(F.regexp_replace(path, r"\.[^./]+$", ""), "/", ".")
    bare = F.when(language == "python", F.regexp_replace(dotted, r"(^|\.)__init__$", "")).when(language == "typescript", F.regexp_replace(dotted, r"(^|\.)index$", "")).when(language == "java", F.lit("")).otherwise(dotted)
    return F.coalesce(F.nullif(F.translate(namespace, "\\", "."), F.lit("")), bare)


def clean_title(title: Column, default: str, limit: int = 80) -> Column:
    """The title without outer white space, cut at `limit` characters; the default for an empty one."""
    bare = F.regexp_replace(title, r"^\s+|\s+$", "")
    return F.coalesce(F.nullif(F.substring(bare, 1, limit), F.lit("")), F.lit(default))


def clean_tags(tags: Column, limit: int = 20) -> Column:
    return F.slice(F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != ""), 1, limit)


def escape_html(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def present(fqn: Column, top: str = "global function") -> Column:
    """(method, owner) of a qualified name, for display."""
    parts = F.split(fqn, r"[.\\]")
    return F.struct(F.element_at(parts, -1).alias("method"), F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(top)).alias("owner"))


def line_reference(text: Column) -> Column:
    """The first [line:n] or [line:n-m] as (first, last), in order; null if there is none or a number is under 1."""
    a = F.regexp_extract(text, r"\[line:(\d{1,9})(?:-(\d{1,9}))?\]", 1)
    b = F.regexp_extract(text, r"\[line:(\d{1,9})(?:-(\d{1,9}))?\]", 2)
    x, y = F.try_to_number(F.nullif(a, F.lit("")), F.lit("999999999")).cast("int"), F.try_to_number(F.nullif(b, F.lit("")), F.lit("999999999")).cast("int")
    y = F.coalesce(y, x)
    return F.when((x >= 1) & (y >= 1), F.struct(F.least(x, y).alias("first"), F.greatest(x, y).alias("last")))


def source_lines(source: Column, first: Column, last: Column) -> Column:
    """Lines first..last (1-based, inclusive) of a source, joined; the range is clipped to the source."""
    lines = F.split(source, "\n")
    return F.array_join(F.slice(lines, F.greatest(first, F.lit(1)), F.greatest(F.least(last, F.size(lines)) - F.greatest(first, F.lit(1)) + 1, F.lit(0))), "\n")


def short_revision(revision: Column) -> Column:
    return F.substring(revision, 1, 8)


def splice(text: Column, start: Column, end: Column, new: Column) -> Column:
    """text with [start, end) (0-based, clipped) replaced."""
    a = F.greatest(F.lit(0), F.least(start, F.length(text)))
    b = F.greatest(a, F.least(end, F.length(text)))
    return F.concat(F.substr(text, F.lit(1), a), new, F.substr(text, b + 1, F.length(text)))
