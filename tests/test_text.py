"""Markdown, references, syntax tokens, labels and names."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import hashing, labels, markdown, names, syntax


@pytest.mark.parametrize(
    ("text", "html"),
    [
        ("", ""),
        (" \n\t\n", ""),
        ("a\nb\n\nc", "<p>a<br>b</p><p>c</p>"),
        ("# one\n## two\n### three\n#### four", "<h1>one</h1><h2>two</h2><h3>three</h3><p>#### four</p>"),
        ("- a\n- b **x**\nafter", "<ul><li>a</li><li>b <strong>x</strong></li></ul><p>after</p>"),
        ("> q `c<d`\n> r", "<blockquote>q <code>c&lt;d</code></blockquote><blockquote>r</blockquote>"),
        ("```py\nx = '1'\n\ny\n```\nz", '<pre><code class="language-py">x = &#39;1&#39;\n\ny</code></pre><p>z</p>'),
        ("```\nopen\n# no heading", "<pre><code>open\n# no heading</code></pre>"),
        ("```\n```", "<pre><code></code></pre>"),
        ("text\n- item", "<p>text</p><ul><li>item</li></ul>"),
        ("**a & b** \"q\"", "<p><strong>a &amp; b</strong> &quot;q&quot;</p>"),
        ("** not bold", "<p>** not bold</p>"),
    ],
)
def test_markdown(text, html):
    assert markdown.to_html(text) == html


def test_expand():
    source = "const v = input;\nif (v < 2) {\n  return false;\n}"
    got = markdown.expand("## Role\n\n[line:3-2]\n\n**done**", "src/S.ts", source, "typescript")
    assert (got.resolved, got.unresolved) == (1, 0) and "<h2>Role</h2>" in got.html and "if (v &lt; 2)" in got.html and "[line" not in got.html
    assert "```typescript\nif (v < 2) {\n  return false;\n```" in got.text and "src/S.ts · 2–3행" in got.text
    lost = markdown.expand("[line:99] x", "run.py", "def run():\n    pass", "python")
    assert (lost.resolved, lost.unresolved) == (0, 1) and "[line:99]" in lost.html and markdown.NOT_FOUND in lost.html
    cut = markdown.expand("[line:2-50]", "r", "a\r\nb\r\nc", "php")
    assert "2–3행" in cut.html and "b\nc" in cut.html
    assert markdown.expand("[line:0] y", "r", "a", "php")[2:] == (0, 0)
    assert markdown.expand("[line:2] y [line:3]", None, None, None)[2:] == (0, 2)


def test_reference_at():
    text = "ab [line:4-2] c"
    assert [markdown.reference_at(text, i) for i in (2, 3, 13, 14)] == [None, (2, 4), (2, 4), None]
    assert markdown.reference_at("[line:0]", 1) is None


def kinds(source, language):
    return [[(t["text"], t["kind"]) for t in line] for line in syntax.tokenize(source, language)]


def test_tokens():
    assert kinds("int f(x) { return 1.5f; } // c", "java")[0][:4] == [("int", "type"), (" ", "plain"), ("f", "function"), ("(x) { ", "plain")]
    assert kinds("a /* b\nc */ d", "java") == [[("a ", "plain"), ("/* b", "comment")], [("c */", "comment"), (" d", "plain")]]
    assert kinds("x = '''a\\'''b\nc''' + f\"y\"", "python")[1] == [("c'''", "string"), (" + ", "plain"), ('f"y"', "string")]
    assert kinds("x = 'a\\'b' # c", "python") == [[("x = ", "plain"), ("'a\\'b'", "string"), (" ", "plain"), ("# c", "comment")]]
    assert kinds("#[A] $b # c", "php")[0][-1] == ("# c", "comment") and kinds("#[A]", "php") == [[("#[", "plain"), ("A", "type"), ("]", "plain")]]
    assert kinds("@Get.x class `t${1}`", "typescript")[0] == [("@Get.x", "annotation"), (" ", "plain"), ("class", "keyword"), (" ", "plain"), ("`t${1}`", "string")]
    assert kinds("'open\nnext", "java") == [[("'open", "string")], [("next", "plain")]]
    assert kinds("", "java") == [[]] and kinds("\n", "unknown") == [[], []]


@pytest.mark.parametrize("language", ["java", "php", "python", "typescript"])
def test_tokens_lose_nothing(language):
    source = "/* a\n*/ \"x\\\n'y' `z\n'''t\n\"\"\" u\n@ @a 1_0.e5 .5 $w é # k\n//\\"
    assert "\n".join("".join(t["text"] for t in line) for line in syntax.tokenize(source, language)) == source
    assert all(a["kind"] != b["kind"] for line in syntax.tokenize(source, language) for a, b in zip(line, line[1:]))


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def test_names(spark):
    lit = F.lit
    assert one(spark, names.normalize_path(lit("\\a\\b")), names.qualified_name(lit(""), F.array(lit("A"), lit("")), lit("f")), names.expression_name(lit("this.a->b(x);")), names.php_simple_name(lit("A\\B"))) == ("a/b", "A.f", "bx", "B")
    assert one(spark, names.short_revision(lit("0123456789")), names.splice(lit("abcdef"), lit(2), lit(4), lit("X")), names.source_lines(lit("a\nb\nc"), lit(2), lit(9))) == ("01234567", "abXef", "b\nc")
    modules = [names.module_name(lit(g), lit(p), lit(n)) for g, p, n in (("python", "pkg/__init__.py", None), ("python", "pkg/mod.py", None), ("typescript", "a/index.ts", None), ("java", "a/B.java", "x.y"), ("php", "a.php", "A\\B"), ("java", "B.java", None))]
    assert one(spark, *modules) == ("pkg", "pkg.mod", "a", "x.y", "A.B", "")
    assert one(spark, names.is_self_reference(lit("this.x")), names.is_self_reference(lit("other.x")), names.resolve_module(lit("a/b.ts"), lit("../c/d.js")), names.resolve_module(lit("a/b.ts"), lit("pkg"))) == (True, False, "c/d", None)
    assert one(spark, names.one_space(lit(" a \n b ")), names.clean_title(lit("  "), "T"), hashing.repository_id(lit("/r"))) == ("a b", "T", "repo_" + hashing.fnv64_of("/r"))


def test_long_texts_hash_alike(spark):
    texts = ["", "a", "é" * 100, None, "x" * 30_000]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", hashing.fnv64_text("t").alias("h")).collect()
    assert [(r.h is None) == (r.t is None) for r in rows] == [True] * 5 and rows[4].h == hashing.fnv64_of("x" * 30_000)
    assert one(spark, hashing.fnv64(F.lit("é" * 100))) == (hashing.fnv64_of("é" * 100),)


def test_labels(spark):
    lit = F.lit
    assert one(spark, labels.impact_label(lit("a.b.c")), labels.impact_label(lit("c")), labels.impact_label(lit(None).cast("string")), labels.role_label(lit("nope")), labels.change_label(lit("moved"))) == ("b.c", "c", labels.UNKNOWN_FUNCTION, "기타", "이동")
    titles = F.array(lit("분석 3"), lit("분석 4"))
    assert one(spark, labels.next_note_title(titles), labels.next_note_title(F.array().cast("array<string>"))) == ("분석 5", "분석 1")
    with pytest.raises(Exception, match="unknown language"):
        one(spark, labels.language(lit("perl")))
    with pytest.raises(Exception):
        one(spark, labels.tags_of(lit("{broken")))
