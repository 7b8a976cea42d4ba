"""Language identification by rank-order profiles: out-of-place distance of n-grams.

A text's n-grams are those of 1 to 3 characters of its words (runs of letters, in lower case), with a space before and
after each word: a letter, two neighbours with a letter among them, three around a letter. A profile lists n-grams by
falling count, ties by code points. A language's profile holds the `profile` first of all training texts; a document's,
its own `own` first. Their distance adds, over the document's n-grams, how far apart the two ranks stand, or `profile`
where the language lacks the n-gram. The least distance wins, ties go to the smaller language by code points. The score
is 1 - distance / (profile * n-grams of the document).

Counts cover all training texts and whole texts: each task adds its own up (and sends them on when PENDING are held), a
shuffle by (language, n-gram) adds the rest, and the first of each language are picked task by task before they meet.
What the driver and the tasks get is `profile` n-grams a language, for at most MAX_LANGUAGES.

Defined results: a text that is null or has no letter is `und` with score 0; so is every text if nothing can be learned
(no labelled text with a letter); documents whose language is null teach nothing and are judged; repeated rows count as
often as they stand; a null doc_id counts as an empty id; an empty table gives an empty one. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, slices, stage, trimmed

#: N-grams of a language's profile and of a document's.
PROFILE, OWN = 400, 400
#: Languages whose profiles are held by the driver and every task.
MAX_LANGUAGES = 2_000
#: (language, n-gram) counts that a task holds before it sends them on.
PENDING = 1 << 20
#: Characters of a text that are cut into n-grams at a time.
_PART = 1 << 20
_SPACE = 32
_folds: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """For every code point its letter in lower case, a space for what isn't a letter. Made once a process."""
    if not _folds:
        table = np.full(sys.maxunicode + 1, _SPACE, np.uint32)
        for i in range(sys.maxunicode + 1):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low) if len(low) == 1 else i
        _folds.append(table)
    return _folds[0]


def _letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters of all texts with a space before each and at the end, runs of spaces as one, and text numbers."""
    whole = " ".join(["", *(t or "" for t in texts), ""])
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(texts) + 1), [1 + len(t or "") for t in texts] + [1])
    chars = _fold()[points]
    keep = np.ones(len(chars), bool)
    keep[1:] = (chars[1:] != _SPACE) | (chars[:-1] != _SPACE)
    return chars[keep], text[keep]


def _counted(owner: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, n-gram, count), sorted, of characters whose letters have owners. An n-gram is three numbers of 21 bits."""
    kinds = np.flatnonzero(np.bincount(chars))  # rising, so that the order of numbers is that of code points
    number = np.zeros(int(kinds[-1]) + 1, np.int64)
    number[kinds] = np.arange(1, len(kinds) + 1)
    c, base = number[chars], len(kinds) + 1
    at = np.flatnonzero(chars[1:-1] != _SPACE) + 1  # the first and the last character are spaces
    left, own, right = c[at - 1], c[at], c[at + 1]
    before = chars[at - 1] == _SPACE  # a pair of letters is counted at its first
    grams = np.concatenate([own * base * base, (own * base + right) * base, ((left * base + own) * base)[before], (left * base + own) * base + right])
    owners = owner[at]
    owners = np.concatenate([owners, owners, owners[before], owners])
    keys = np.sort(owners * base**3 + grams)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([first, [len(keys)]]))
    keys = keys[first]
    points = np.concatenate([[0], kinds])
    gram = (points[keys // base**2 % base] << 42) | (points[keys // base % base] << 21) | points[keys % base]
    return keys // base**3, gram, counts


def _merged(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parts of (owner, n-gram, count), whatever their order, added up and sorted."""
    owner, gram, count = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((gram, owner))
    owner, gram, count = owner[order], gram[order], count[order]
    if not len(owner):
        return owner, gram, count
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (gram[1:] != gram[:-1])]))
    return owner[first], gram[first], np.add.reduceat(count, first)


def _windows(chars: np.ndarray, text: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stretches of at most _PART letters; each begins and ends with a character that isn't counted there."""
    for begin in range(0, max(len(chars) - 2, 0), _PART):
        yield chars[begin : begin + _PART + 2], text[begin : begin + _PART + 2]


def grams(texts: list[str | None], owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, n-gram, count) of texts; their own numbers by default."""
    chars, text = _letters(texts)
    if owner is not None:
        text = owner[np.minimum(text, len(owner) - 1)]
    found = []
    for part, whose in _windows(chars, text):
        if (part[1:-1] != _SPACE).any():
            found.append(_counted_edges(whose, part))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return found[0] if len(found) == 1 else _merged(found)


def _counted_edges(owner: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """_counted, in halves where the numbers of owners and characters would not fit into 64 bits."""
    kinds = len(np.unique(chars)) + 1
    if (int(owner.max(initial=0)) + 1) * kinds**3 < 1 << 62 or len(chars) < 4:
        return _counted(owner, chars)
    low = int(owner.min())
    if low:
        o, g, n = _counted_edges(owner - low, chars)
        return o + low, g, n
    half = len(chars) // 2
    return _merged([_counted_edges(owner[: half + 1], chars[: half + 1]), _counted_edges(owner[half - 1 :], chars[half - 1 :])])


@dataclass
class Profiles:
    """Languages, the n-grams of any profile (sorted), and their ranks by language; `size` where one lacks them."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    size: int
    own: int = OWN

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        text, gram, count = grams(texts)
        rows = len(texts)
        order = np.lexsort((gram, -count, text))
        text, gram = text[order], gram[order]
        begin = np.searchsorted(text, np.arange(rows))
        rank = np.arange(len(text)) - begin[text]
        text, gram, rank = (a[rank < self.own] for a in (text, gram, rank))
        held = np.bincount(text, minlength=rows)
        if not self.languages:
            return ["und"] * rows, np.zeros(rows)
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        known = self.grams[at] == gram
        best, who = np.full(rows, np.iinfo(np.int64).max), np.zeros(rows, np.int64)
        for language in range(len(self.languages)):
            there = np.where(known, self.ranks[language, at], self.size)
            apart = np.where(there < self.size, np.abs(there - rank), self.size)
            distance = np.bincount(text, apart, rows).astype(np.int64)
            nearer = distance < best
            best[nearer], who[nearer] = distance[nearer], language
        score = np.where(held > 0, 1 - best / np.maximum(self.size * held, 1), 0.0)
        return [self.languages[w] if n else "und" for w, n in zip(who, held, strict=True)], np.clip(score, 0, 1)


def _training_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, gram, c), added up over the task, sent on when PENDING are held."""
    numbers: dict[str, int] = {}
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def sent() -> pa.RecordBatch:
        owner, gram, count = held.pop()
        names = pa.array(list(numbers), pa.string())
        return pa.RecordBatch.from_arrays([names.take(pa.array(owner)), pa.array(gram), pa.array(count)], names=["lang", "gram", "c"])

    for batch in slices(batches, "text"):
        owner = np.array([numbers.setdefault(v, len(numbers)) for v in batch.column(0).to_pylist()])
        found = [*held, grams(batch.column(1).to_pylist(), owner)]
        held[:] = [_merged(found)]
        if len(held[0][0]) > PENDING:
            yield sent()
    if held:
        yield sent()


def learn(rows: DataFrame, profile: int = PROFILE, own: int = OWN) -> Profiles:
    """Profiles from (lang, text), neither null."""
    counts = rows.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = counts.mapInArrow(trimmed(_training_counts), "lang string, gram bigint, c bigint").groupBy("lang", "gram").agg(F.sum("c").alias("c"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c"), "gram"))
    with scratch(rows.sparkSession):
        first = stage(counts.withColumn("rank", rank).where(F.col("rank") <= profile).select("lang", "gram", "rank"), "profiles")
        n = first.where("rank = 1").count()
        if n > MAX_LANGUAGES:
            raise ValueError(f"{n} languages: profiles are held whole for at most {MAX_LANGUAGES}")
        got = first.collect()  # at most MAX_LANGUAGES * profile rows
    languages = sorted({r["lang"] for r in got})
    kinds = np.unique(np.array([r["gram"] for r in got], np.int64))
    ranks = np.full((len(languages), len(kinds)), profile, np.int64)
    number = {name: i for i, name in enumerate(languages)}
    for r in got:
        ranks[number[r["lang"]], np.searchsorted(kinds, r["gram"])] = r["rank"] - 1
    return Profiles(languages, kinds, ranks, profile, own)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 1 when divided by 3; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3)) == 1


def identify(docs: DataFrame, model: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            language, score = model.judge(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(language, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(trimmed(run), "doc_id bigint, lang_pred string, score double")


def identify_held_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the labelled documents that aren't held out."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(F.col(id_col)))
    model = learn(known.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")), **options)
    judged = identify(docs, model, id_col, text_col)
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


#: DuckDB SQL of the query. crc32 has no function there: it is folded bit by bit.
SQL = rf"""
WITH ids AS (SELECT DISTINCT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS x FROM documents),
crc AS (
  SELECT doc_id, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(x) + 1), lambda i: CAST(ord(substr(x, i, 1)) AS BIGINT))),
    lambda h, b: list_reduce(list_concat([xor(h, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END)), 4294967295::BIGINT) % 3 = 1 AS held FROM ids),
d AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, lang, held, ' ' || lower(regexp_replace(coalesce(text, ''), '[^\p{{L}}]+', ' ', 'g')) || ' ' AS t FROM documents JOIN crc USING (doc_id)),
w AS (SELECT n, unnest(list_filter(string_split(t, ' '), lambda x: x <> '')) AS word FROM d),
wc AS MATERIALIZED (SELECT n, ' ' || word || ' ' AS p, count(*) AS c FROM w GROUP BY ALL),
pieces AS (
  SELECT n, substr(p, i, k) AS gram, c FROM wc, unnest([1, 2, 3]) AS ks(k), unnest(range(1, length(p) - k + 2)) AS r(i)),
counted AS MATERIALIZED (SELECT n, gram, CAST(sum(c) AS BIGINT) AS c FROM pieces WHERE gram <> ' ' GROUP BY ALL),
trained AS (SELECT lang, gram, sum(c) AS c FROM counted JOIN d USING (n) WHERE lang IS NOT NULL AND NOT held GROUP BY ALL),
profile AS MATERIALIZED (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY c DESC, gram) - 1 AS rank FROM trained QUALIFY rank < {PROFILE}),
own AS MATERIALIZED (SELECT n, gram, row_number() OVER (PARTITION BY n ORDER BY c DESC, gram) - 1 AS rank FROM counted QUALIFY rank < {OWN}),
held AS (SELECT n, count(*) AS m FROM own GROUP BY n),
met AS (SELECT n, lang, sum({PROFILE} - abs(own.rank - profile.rank)) AS near FROM own JOIN profile USING (gram) GROUP BY ALL),
far AS (
  SELECT n, l.lang, m, CAST({PROFILE} * m - coalesce(near, 0) AS BIGINT) AS distance FROM held CROSS JOIN (SELECT DISTINCT lang FROM profile) l LEFT JOIN met USING (n, lang)),
best AS (SELECT n, m, lang, distance FROM far QUALIFY row_number() OVER (PARTITION BY n ORDER BY distance, lang) = 1)
SELECT d.doc_id, d.held AS held_out, coalesce(b.lang, 'und') AS lang_pred, coalesce(1 - CAST(distance AS DOUBLE) / ({PROFILE} * m), 0) AS score
FROM d LEFT JOIN best b USING (n)
"""
