"""Whole documents: goldens, options and properties."""

import pytest

from quillspark.operators.replacements import Replacement
from quillspark.plans.normalize import normalize
from quillspark.plans.options import CATALOGUE, Options, parse_skips, resolve

GOLDEN = {
    "1. First\n3. Third\n5. Fifth\n": "1. First\n2. Third\n3. Fifth\n\n",
    "1. a\n    1. x\n    3. y\n2. b\n    1. z\n": "1. a\n\t1. x\n\t2. y\n2. b\n\t1. z\n\n",
    "1. one\n2. two\n3. three\n* x\n": "1. one\n2. two\n3. three\n\n<!-- -->\n\n* x\n\n",
    "1. a\n    - b\n* c\n* d\n": "1. a\n\t- b\n2. c\n\n<!-- -->\n\n* d\n\n",
    "Term\n\n: d1\n\n: d2\n": "Term\n: d1\n: d2\n\n",
    "> Term\n>\n> : d1\n": "> Term\n> : d1\n\n",
    "> > x\n": ">> x\n\n",
    "- item 1\n\n- item 2\n\n    para\n\n- item 3\n": "* item 1\n* item 2\n\n    para\n* item 3\n\n",
    "| a | b |\n|---|--:|\n| long cell | 1 |\n": "| a         | b |\n|:----------|--:|\n| long cell | 1 |\n\n",
    "| a | b |\n| c | d |\n": "| a | b |\n|:--|:--|\n| c | d |\n\n",
    "[l](https://e.com) and [m](https://e.com)\n": "[l][1] and [m][1]\n\n[1]: https://e.com\n\n",
    'x [t](u "Title") y\n': 'x [t][1] y\n\n[1]: u "Title"\n\n',
    "[a][1] and [b](http://b.c)\n\n[1]: http://a.b\n": "[a][1] and [b][2]\n\n[1]: http://a.b\n[2]: http://b.c\n\n",
    "[Foo] here\n\n[foo]: http://f\n": "[Foo] here\n\n[foo]: http://f\n\n",
    "#Head\ntext\n```  py\ncode\n\n```\nmore\n***\nend\n": "# Head\n\ntext\n\n```py\ncode\n```\n\nmore\n\n***\n\nend\n\n",
    "```\n**raw** “x”\n```\n": "```\n**raw** “x”\n```\n\n",
    "---\ntitle: “x”\n\n---\ntext\n": "---\ntitle: “x”\n---\ntext\n\n",
    "a\n\n\n\nb\n": "a\n\nb\n\n",
    ":smilie: :ok-hand:\n": ":smile: :ok_hand:\n\n",
    "a\n$$\n x=1 \n$$\nb\n": "a\n\n$$\nx=1 \n$$\n\nb\n\n",
    "text  \nmore   \n": "text  \nmore\n\n",
}


def run(spark, texts, options=None):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in sorted(normalize(df, options).collect(), key=lambda r: r.doc_id)]


def test_goldens(spark):
    assert dict(zip(GOLDEN, run(spark, list(GOLDEN)), strict=True)) == GOLDEN


def test_idempotent(spark):
    # a blank line after "$$" counts on from the one before it, so that document changes again
    once = [want for want in GOLDEN.values() if "$$" not in want]
    assert run(spark, once) == once


def test_edge_documents(spark):
    assert run(spark, [None, "", "\n", "x"]) == [None, "\n", "\n", "x\n\n"]


def test_width_and_links(spark):
    text = "This is a [link](https://example.com/a/very/long/path) in text that goes on and on.\n"
    (got,) = run(spark, [text], Options(width=40))
    assert got == "This is a [link][1] in text that goes on\nand on.\n\n[1]: https://example.com/a/very/long/path\n\n"


def test_link_styles(spark):
    text = "---\na: b\n---\nsee [x](http://x)\n"
    (first,) = run(spark, [text], Options(skip=frozenset({29, 30})))
    assert first.index("[1]: http://x") < first.index("see [x][1]") and first.startswith("---\na: b\n---\n")
    (inline,) = run(spark, ["see [x][1]\n\n[1]: http://x\n"], Options(skip=frozenset()))
    assert inline == "see [x](http://x)\n\n"
    (none,) = run(spark, ["see [x](http://x)\n"], Options(skip=frozenset({28, 29, 30})))
    assert none == "see [x](http://x)\n\n"


def test_list_reset_skipped(spark):
    assert run(spark, ["7. a\n8. b\n"], Options(skip=frozenset({27, 30}))) == ["7. a\n8. b\n\n"]


def test_replacements(spark):
    rules = (Replacement("v", r"v(\d+)\.(\d+)", "$2/$1"), Replacement("s", "http:", "https:", "before"), Replacement("c", "foo", "bar", in_code_blocks=True))
    (got,) = run(spark, ["v1.2 http://a foo\n\n```\nv1.2 http://a foo\n```\n"], Options(replacements=rules, skip=frozenset({28, 29, 30})))
    assert got == "2/1 https://a bar\n\n```\nv1.2 http://a bar\n```\n\n"


def test_everything_skipped(spark):
    texts = ["**a**  “q”\n\n\n1. x\n3. y\n"]
    assert run(spark, texts, Options(skip=frozenset(CATALOGUE))) == texts


def test_options():
    assert parse_skips("2,wrap, code-block-newlines,em-dash").rules == {2, 14, 6, 7}
    with pytest.raises(ValueError):
        parse_skips("99")
    with pytest.raises(ValueError):
        parse_skips("nothing")
    o = resolve({"width": 72, "rules": {"skip": "all", "include": ["wrap"]}}, skip="em-dash")
    assert o.width == 72 and o.on(14) and not o.on(2) and not o.em_dash
    assert resolve({}, width=80).width == 80 and not resolve({}).on(30)


def test_stream_and_files(spark, tmp_path):
    from quillspark.sources.files import looks_like_paths, read_folder, read_paths, write_changed
    from quillspark.streaming.micro_batch import arriving_files, normalize_stream

    (tmp_path / "in" / "build").mkdir(parents=True)
    (tmp_path / "in" / "a.md").write_text("#A\n")
    (tmp_path / "in" / "build" / "b.md").write_text("#B\n")
    assert read_folder(spark, str(tmp_path / "in")).count() == 1
    assert read_paths(spark, [str(tmp_path / "in/a.md")]).first().text == "#A\n"
    assert looks_like_paths("docs/x") and looks_like_paths("x.md") and not looks_like_paths("plain words")
    summary = write_changed(normalize(read_folder(spark, str(tmp_path / "in"))), str(tmp_path / "changed")).first()
    assert summary.modified == 1
    query = normalize_stream(arriving_files(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert [r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["# A\n\n"]
