"""Secret scan: candidate spans, and how many owners share each candidate in the whole corpus.

Candidates are found in whole texts: the base kinds assign, access and hex, and the further kinds key (a private key's
header), jwt, prefixed (tokens with a public issuer's prefix) and opaque (mixed runs of high entropy). Each candidate's
value is hashed; hashes are aggregated over the corpus to the number of distinct repositories and owners. A value
that many owners hold is an example that was copied; one of a single owner, with no placeholder in it and with the
entropy of a random string, looks live. These counts decide which further candidates become spans: none that is copied,
and opaque runs only if they look live. Base spans stay, with their status.
Aggregation is by (hash, repository, owner) first, so a value that a third of all rows holds is reduced before it is
shuffled; counts go back to candidates with hot values apart (see keyed_join).

Defined results: null and empty texts have no span; repeated rows are reported each, but their owner counts once; a
null owner or repository is one owner or repository; spans are code points, end exclusive; of spans that begin at one
place the kind decides the order; an empty table is empty. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_join, kept, scratch, slices, stage

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
_HEX32 = re.compile(r"[0-9a-f]{32,}")
KEY = re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")
JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
#: Public prefixes of issued tokens.
PREFIXED = re.compile(r"(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})")
OPAQUE = re.compile(r"[A-Za-z0-9+/_=-]{32,}", re.A)
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "key", "jwt", "prefixed", "opaque")
PLACEHOLDER = re.compile(r"example|sample|dummy|placeholder|changeme|your|xxxx|test|1234567|(.)\1{5}", re.I | re.A)
#: RE2 pattern without which a text holds no candidate of any kind.
_ANY = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]|[0-9a-f]{32}|-----BEGIN |eyJ|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|AIza|[A-Za-z0-9+/_=-]{32}"


def entropy(value: str) -> float:
    """Bits a character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, value) of the kinds assign, access and hex, by start, then kind."""
    out = [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end(), m[0]) for m in _HEX32.finditer(text)]  # maximal runs, so as HEX with 32 or more
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


class _Cover:
    """Spans (start, end) in order of start, with the furthest end so far: answers by binary search."""

    def __init__(self, spans: list[tuple[int, int]]):
        spans = sorted(spans)
        self.starts, self.ends = [s for s, _ in spans], list(accumulate((e for _, e in spans), max))

    def holds(self, start: int, end: int) -> bool:
        """One of the spans holds all of start..end."""
        i = bisect_right(self.starts, start)
        return i > 0 and self.ends[i - 1] >= end

    def meets(self, start: int, end: int) -> bool:
        """One of the spans overlaps start..end."""
        i = bisect_left(self.starts, end)
        return i > 0 and self.ends[i - 1] > start


def added_spans(text: str, base: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """Candidates of the further kinds that no base span covers; opaque ones that nothing else overlaps."""
    found = [(kind, m.start(), m.end(), m[0]) for kind, pattern in (("key", KEY), ("jwt", JWT), ("prefixed", PREFIXED)) for m in pattern.finditer(text)]
    taken, own = _Cover([(s, e) for _, s, e, _ in [*base, *found]]), _Cover([(s, e) for _, s, e, _ in base])
    opaque = [("opaque", m.start(), m.end(), m[0]) for m in OPAQUE.finditer(text) if not taken.meets(m.start(), m.end())]
    mixed = [c for c in opaque if entropy(c[3]) >= 4.2 and all(re.search(kind, c[3]) for kind in (r"\d", "[a-z]", "[A-Z]"))]
    return [f for f in found if not own.holds(f[1], f[2])] + mixed


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("hash", pa.int64()), ("random", pa.bool_())])


def _span(s: tuple[str, int, int, str]) -> dict:
    value = s[3]
    digest = int.from_bytes(hashlib.sha256(value.encode("utf-8", "surrogatepass")).digest()[:8], "big", signed=True)
    return {"kind": s[0], "start": s[1], "end": s[2], "hash": digest, "random": entropy(value) >= 3.0 and not PLACEHOLDER.search(value)}


def scanner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow: (doc_id, repo, owner, text) to (doc_id, repo, owner, base, added)."""
    for batch in slices(batches, "text"):
        text = batch.column(3)
        maybe = pc.fill_null(pc.match_substring_regex(text, _ANY), False).to_pylist()
        base, added = [], []
        for i, hit in enumerate(maybe):
            own = base_spans(t := text[i].as_py()) if hit else []
            base.append([_span(s) for s in own])
            added.append([_span(s) for s in added_spans(t, own)] if hit else [])
        kind = pa.list_(_SPAN)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(base, kind), pa.array(added, kind)], names=["doc_id", "repo", "owner", "base", "added"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_cols: tuple[str, ...] = ("source", "lang"), owner_col: str = "source", copied_owners: int = 3) -> DataFrame:
    """A row for each document: (doc_id, base, spans): arrays of (kind, start, end, hash, repos, owners, status).

    status: copied (at least `copied_owners` owners hold the value), live (one owner, random, no placeholder), else
    unsure. base has the base kinds alone, without counts."""
    with scratch(docs.sparkSession):
        repo = F.to_json(F.array(*[F.col(c).cast("string") for c in repo_cols]))
        base = docs.select(F.col(id_col).cast("long").alias("doc_id"), repo.alias("repo"), F.col(owner_col).cast("string").alias("owner"), F.col(text_col).alias("text"))
        span = "array<struct<kind:string,start:bigint,end:bigint,hash:bigint,random:boolean>>"
        found = base.mapInArrow(scanner, f"doc_id bigint, repo string, owner string, base {span}, added {span}")
        found = stage(found.withColumn("row", F.monotonically_increasing_id()), "spans")
        each = found.where("size(base) + size(added) > 0").select("row", "repo", "owner", F.explode(F.concat("base", "added")).alias("s")).withColumn("hash", F.col("s.hash"))
        held = each.select("hash", "repo", "owner").distinct()
        counts = held.groupBy("hash").agg(F.countDistinct(F.coalesce("repo", F.lit("null"))).alias("repos"), F.countDistinct(F.struct(F.col("owner").isNull(), "owner")).alias("owners"))
        judged = keyed_join(each.select("row", "hash", "s"), stage(counts, "counts"), "hash")
        status = F.when(F.col("owners") >= copied_owners, "copied").when((F.col("owners") == 1) & F.col("s.random"), "live").otherwise("unsure")
        rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("s.kind"))
        judged = judged.withColumn("status", status).where((rank <= len(BASE_KINDS)) | F.when(F.col("s.kind") == "opaque", F.col("status") == "live").otherwise(F.col("status") != "copied"))
        full = F.struct(F.col("s.start").alias("start"), rank.alias("rank"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"), "hash", "repos", "owners", "status")
        per_row = judged.groupBy("row").agg(F.array_sort(F.collect_list(full)).alias("spans"))
        out = found.join(per_row, "row", "left").select("doc_id", "base", F.coalesce("spans", F.array().cast(per_row.schema["spans"].dataType)).alias("spans"))
        return kept(stage(out, "secrets"))


def scan_digest(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_copied, n_live) of every document."""
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda c, f, v: F.size(F.filter(c, lambda s: s[f] == v)).cast("long")
    kinds = [count("base", "kind", k).alias(f"n_{k}") for k in BASE_KINDS]
    found = scan(docs, **options)
    return found.select("doc_id", *kinds, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), count("spans", "status", "copied").alias("n_copied"), count("spans", "status", "live").alias("n_live"))
