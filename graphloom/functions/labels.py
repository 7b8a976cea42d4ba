"""Short texts for people: labels of symbols, items and changes, default titles, tags as JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What reports and exports call kinds of change, roles and states.
CHANGES = {"added": "추가", "modified": "수정", "deleted": "삭제", "moved": "이동"}
ROLES = {"entry": "진입점", "core": "주요 로직", "data": "데이터 접근", "external": "외부 연동", "error": "예외 처리", "other": "기타"}
UNKNOWN_FUNCTION = "알 수 없는 함수"
NO_BASELINE, UNCHANGED = "비교할 이전 분석이 없습니다.", "마지막 분석 이후 함수 변경이 없습니다."
SUMMARY = "%d개 파일 · %d개 함수 변경 · %d개 호출자 확인 필요"
NOTE, DEFAULT_NOTE = "분석", "기본 분석"
LANGUAGES, CONFIDENCES = ("java", "php", "python", "typescript"), ("resolved", "ambiguous", "unresolved")


def _named(value: Column, names: dict[str, str], other: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), value), other)


def change_label(kind: Column) -> Column:
    return _named(kind, CHANGES, kind)


def role_label(role: Column) -> Column:
    return _named(F.coalesce(role, F.lit("")), ROLES, F.lit(ROLES["other"]))


def impact_label(fqn: Column) -> Column:
    """The last two parts of a name; of an unknown symbol (null) a text that says so."""
    parts = F.filter(F.split(fqn, r"\."), lambda p: p != "")
    last = F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2)
    return F.when(fqn.isNull(), UNKNOWN_FUNCTION).otherwise(F.coalesce(F.nullif(F.array_join(last, "."), F.lit("")), fqn))


def impact_summary(status: Column, files: Column, changes: Column, callers: Column) -> Column:
    return F.when(status == "noBaseline", NO_BASELINE).when(status == "unchanged", UNCHANGED).otherwise(F.format_string(SUMMARY, files, changes, callers))


def item_label(current: Column, fqn: Column, signature: Column) -> Column:
    """Name and signature of an item's current symbol (a struct, or null), else as captured."""
    return F.concat(F.coalesce(current["fqn"], fqn), F.coalesce(current["signature"], signature))


def next_note_title(titles: Column) -> Column:
    """The first numbered title, from one more than there are, that none of the titles (an array) has.

    Of n + 1 numbers one at least is free, so no more are tried."""
    n = F.size(titles)
    tried = F.transform(F.sequence(n + 1, 2 * n + 1), lambda i: F.concat(F.lit(f"{NOTE} "), i.cast("string")))
    return F.get(F.filter(tried, lambda t: ~F.array_contains(titles, t)), 0)


def tags_json(tags: Column) -> Column:
    return F.to_json(tags)


def tags_of(json: Column) -> Column:
    """The tags of a JSON array; any other text is an error."""
    return F.from_json(json, "array<string>", {"mode": "FAILFAST"})


def known(value: Column, values: tuple[str, ...], what: str) -> Column:
    """The value itself; one that isn't among the values is an error."""
    return F.when(value.isin(*values), value).otherwise(F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(value, F.lit("null")))))


def language(value: Column) -> Column:
    return known(value, LANGUAGES, "language")


def confidence(value: Column) -> Column:
    return known(value, CONFIDENCES, "confidence")
