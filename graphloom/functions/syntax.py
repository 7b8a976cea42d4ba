"""Syntax tokens of source texts, by line: one pattern a language over the whole text, and a classifier of words."""

from __future__ import annotations

import re
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that a viewer marks as keywords and as types, by language.
KEYWORDS = {
    "java": "abstract assert break case catch class continue default do else enum extends final finally for if implements import instanceof interface new package private protected public record return sealed static super switch synchronized this throw throws try var while yield",
    "python": "and as assert async await break case class continue def del elif else except False finally for from global if import in is lambda match None nonlocal not or pass raise return True try while with yield",
    "php": "abstract and array as break callable case catch class clone const continue declare default do echo else elseif empty enddeclare endfor endforeach endif endswitch endwhile enum eval exit extends false final finally fn for foreach function global goto if implements include include_once instanceof insteadof interface isset list match namespace new null or php print private protected public readonly require require_once return static switch throw trait true try unset use var while xor yield",
    "typescript": "abstract any as asserts async await break case catch class const constructor continue debugger declare default delete do else enum export extends false finally for from function get if implements import in infer instanceof interface keyof let namespace never new null of private protected public readonly return satisfies set static super switch this throw true try type typeof undefined unknown using var void while with yield",
}
TYPES = {
    "java": "boolean byte char double float int long short void Boolean Byte Character Double Float Integer Long Object String Void",
    "python": "bool bytes dict float int list object set str tuple type",
    "php": "bool float int iterable mixed never object self string void",
    "typescript": "Array bigint boolean Date Error Map number Object Promise Record Set string symbol",
}
#: Suffixes and the language that a viewer takes a file for; any other is java.
VIEWED = ((".py", "python"), (".php", "php"), (".ts", "typescript"), (".tsx", "typescript"), (".mts", "typescript"), (".cts", "typescript"))

KINDS = ("plain", "annotation", "comment", "function", "keyword", "number", "string", "type")


def viewed_language(path: Column) -> Column:
    out = F.lit("java")
    for suffix, language in VIEWED:
        out = F.when(path.endswith(suffix), language).otherwise(out)
    return out


def _strings(language: str) -> str:
    """Strings: tripled quotes run over lines (escapes count in the first line alone), single ones end with the line."""
    prefix = "[rRuUbBfF]{0,2}" if language == "python" else ""
    quotes = ["'", '"'] + (["`"] if language == "typescript" else [])
    out = []
    for q in quotes:
        three = q * 3
        out.append(rf"{prefix}{three}(?:(?!{three})(?:\\[^\n]?|[^\\\n]))*(?:{three}|\n(?s:.*?)(?:{three}|\Z)|\Z)")
        out.append(rf"{prefix}{q}(?:\\[^\n]?|[^\\\n{q}])*{q}?")
    return "|".join(out)


@cache
def _pattern(language: str) -> re.Pattern:
    comment = {"python": r"\#[^\n]*", "php": r"//[^\n]*|/\*(?s:.*?)(?:\*/|\Z)|\#(?!\[)[^\n]*"}.get(language, r"//[^\n]*|/\*(?s:.*?)(?:\*/|\Z)")
    number = r"(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[fFdDlL]?"
    return re.compile(rf"(?P<comment>{comment})|(?P<string>{_strings(language)})|(?P<annotation>@[A-Za-z_$][\w$.]*)|(?P<number>{number})|(?P<word>[A-Za-z_$][\w$]*)|(?P<plain>[\s\S])", re.A)


@cache
def _words(language: str) -> tuple[frozenset, frozenset]:
    return frozenset(KEYWORDS[language].split()), frozenset(TYPES[language].split())


def tokenize(source: str, language: str) -> list[list[dict]]:
    """A list of tokens {text, kind} for each line; neighbours of one kind are one token. Unknown languages are java's."""
    language = language if language in KEYWORDS else "java"
    keywords, types = _words(language)
    lines: list[list[dict]] = [[]]

    def put(text: str, kind: str) -> None:
        for i, part in enumerate(text.split("\n")):
            if i:
                lines.append([])
            if part and lines[-1] and lines[-1][-1]["kind"] == kind:
                lines[-1][-1]["text"] += part
            elif part:
                lines[-1].append({"text": part, "kind": kind})

    bracket = -1  # the last opening bracket of the line at hand, found once a line
    end = -1
    for m in _pattern(language).finditer(source):
        kind = m.lastgroup
        if kind == "word":
            if m.start() >= end:
                end = source.find("\n", m.end())
                end = len(source) if end < 0 else end
                bracket = source.rfind("(", m.start(), end)
            word = m[0]
            kind = "keyword" if word in keywords else "type" if word in types or "A" <= word[0] <= "Z" else "function" if bracket >= m.end() else "plain"
        put(m[0], kind)
    return lines
