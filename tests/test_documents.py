"""Whole documents by what they must and must not hold, and rows that share an id or have none."""

from concurrent.futures import ThreadPoolExecutor

import pytest

from quillspark.operators.replacements import Replacement
from quillspark.plans.normalize import normalize
from quillspark.plans.options import Options

BEGIN = Options(skip=frozenset({29, 30}))
INLINE = Options(skip=frozenset({28, 29}))


def case(text, has=(), lacks=(), options=None, exact=None):
    return text, tuple(has), tuple(lacks), options or Options(), exact


SPACES = Replacement("spaces", "  +", " ")
VERSION = Replacement("version", r"(\d+)\.(\d+)", "$2.$1", "before")
HTTPS = Replacement("https", "http://", "https://")
HEADS = Replacement("heads", r"(?m)^\[b\](.*?)\[/b\]", "## $1\n", "before")
QUOTE = Replacement("quote", r"(?s)\[quote\]\n(.*?)\[/quote\]", "> $1", "before")
GRID = Replacement("grid", r"(?ms)^\[table\]\n(.*)\n(.*?)\[/table\]", "$1\n:-- | :-- | :-- \n$2\n", "before")
WORD = Replacement("word", "alpha", "omega", "before")
WORD_IN_CODE = Replacement("word", "alpha", "omega", "before", in_code_blocks=True)

CASES = {
    "bullets by level": case("* One\n    - Two\n        + Three\n", ["* One", "\t- Two", "\t\t+ Three"]),
    "numbers in order": case("1. Uno\n3. Tres\n5. Cinco\n", ["1. Uno", "2. Tres", "3. Cinco"], ["3. Tres", "5. Cinco"]),
    "nested numbers": case("1. A\n    1. A one\n    3. A three\n2. B\n    1. B one\n", ["1. A\n", "2. B\n", "\t1. A one", "\t2. A three", "\t1. B one"]),
    "numbers, then bullets": case("1. A\n2. B\n* Cut off\n", ["1. A", "2. B", "<!-- -->", "* Cut off"]),
    "bullets, then numbers": case("* A\n- B\n+ C\n1. Cut off\n", ["<!-- -->", "1. Cut off"]),
    "bold": case("Some **strong** text.\n", ["__strong__"], ["**strong**"]),
    "italic": case("Some _light_ text.\n", ["*light*"], ["_light_"]),
    "both": case("***strong and light***\n", ["__*strong and light*__"]),
    "file names": case("See _my_file_a.md and _other_b.txt or my_file_a.md.\n\n_my_file_a.md leads, _my_file_a.md ends.\n", ["_my_file_a.md", "_other_b.txt", " my_file_a.md"]),
    "underscores still light": case("_one_ word and __two__ words.\n\n_three_ and __four__ lead.\n", ["*one*", "__two__", "*three*", "__four__"], ["_one_ ", " _three_"]),
    "names beside emphasis": case("_one_ word and _my_file_a.md here.\n\n__two__ words and __my_file_a.md here.\n", ["*one*", "_my_file_a.md", "__two__", "__my_file_a.md"], ["_one_"]),
    "mixed list": case("1. Item\n    * inner\n    + more\n        1. deep\n        3. deeper\n1. Root\n4. last\n* Cut off\n", ["1. Item", "2. Root", "3. last", "\t\t1. deep", "\t\t2. deeper", "<!-- -->", "* Cut off"]),
    "emphasis is no item": case("*A whole line of it.*\n\n*Only this* at the start.\n\n_A whole line below._\n\n_Only that_ at the start.\n", ["*A whole line of it.*", "*Only this* at", "*A whole line below.*", "*Only that* at"], ["* A", "* Only"], Options(width=120)),
    "definitions": case("Word\n\n: first\n\n: second\n", ["Word\n: first\n: second\n"], [": first\n\n"]),
    "quoted definitions": case("> Word\n>\n> : first\n>\n> : second\n", ["> Word\n> : first\n> : second\n"], ["first\n>\n", "Word\n>\n"]),
    "quote markers": case("> > inner\n", [">> inner"], ["> > inner"]),
    "quote markers left": case("> > inner\n", ["> > inner"], [], Options(skip=frozenset({30, 32}))),
    "tight lists": case(
        "* a\n\n* b\n\n    * c\n\n    * d\n\n        with a paragraph\n* e\n\n\n    ```\n    code\n    ```\n\n* f\n1. g\n\n2. h\n",
        ["* a\n* b\n", "\t- c\n\t- d\n", "\t- d\n\n        with a paragraph\n", "* e\n\n    ```\n    code\n    ```\n* f\n", "1. g\n2. h\n"],
    ),
    "everything at once": case(
        "# Blank lines\n\n\n- x\n\n- y\n\n\nTerm\n\n: D1\n\n: D2\n\n\n```py\nprint(1)\n\n\n```\n\n[ref] :https://e.com  \"T\"\n\n\nSee [an example][ref]\n\n\n| H | I |\n|---|---|\n| c | d |\n\n\n- [ ] Task\n\n---\n\n* p\n\n\n\n* q\n\n\n\t* r\n\n\n\t* s\n",
        ["Term\n: D1\n: D2\n", "* x\n* y\n", "* p\n* q\n\t- r\n\t- s\n", "print(1)\n```\n", "| H | I |\n|:--|:--|\n| c | d |\n", '[ref]: https://e.com "T"'],
    ),
    "tables are not wrapped": case("| A very long heading of a column | B |\n| --- | --- |\n| a cell that is longer than the width | c |\n", ["A very long heading of a column", "a cell that is longer than the width"], [], Options(width=20)),
    "wrapped after links": case("Here is a [word](https://e.com/so/long/a/path/that/it/would/wrap) in text.\n", ["Here is a [word][1] in text.\n", "[1]: https://e.com/so/long/a/path/that/it/would/wrap\n"], ["](https"], Options(width=40)),
    "references by default": case("A [word](https://e.com) here.\n", ["[word][1]"], exact="A [word][1] here.\n\n[1]: https://e.com\n\n"),
    "links in place": case("A [word][1] here.\n\n[1]: https://e.com\n", ["[word](https://e.com)"], ["[1]:"], INLINE),
    # the blank line after the definitions counts on from the one before them, as kept lines do not restart it
    "definitions first": case("A [word](https://e.com) here.\n", [], [], BEGIN, "\n[1]: https://e.com\nA [word][1] here.\n\n"),
    "definitions below front matter": case("---\ntitle: T\n---\n\nA [word](https://e.com).\n", ["---\ntitle: T\n---\n", "[1]: https://e.com"], [], BEGIN),
    "one target, one number": case("[a](https://e.com) and [b](https://e.com).\n", ["[a][1]", "[b][1]", "\n[1]: https://e.com\n"], ["[2]"]),
    "links in items": case("- Item [a](https://e.com)\n- Other\n", ["* Item [a][1]\n* Other\n", "[1]: https://e.com"]),
    "numbers kept": case("7. A\n8. B\n", ["7. A", "8. B"], [], Options(skip=frozenset({27, 30}))),
    "numbers from one": case("7. A\n8. B\n", ["1. A", "2. B"], ["7. A"]),
    "one marker": case("- A\n+ B\n* C\n", ["* A\n* B\n* C\n"]),
    "markers left": case("1. A\n3. B\n5. C\n", ["1. A", "3. B", "5. C"], [], Options(skip=frozenset({26, 30}))),
    "titles": case('A [word](https://e.com "T").\n', ["[word][1]", '[1]: https://e.com "T"']),
    "unused go": case("A [word][1].\n\n[1]: https://a.com\n[2]: https://b.com\n", ["[word][1]", "[1]: https://a.com"], ["b.com"]),
    "unused stay": case("A [word][1], [x](https://c.com).\n\n[1]: https://a.com\n[2]: https://b.com\n", ["[word][1]", "[x][3]", "[1]: https://a.com\n[3]: https://c.com\n[2]: https://b.com\n"], [], Options(keep_unreferenced=True)),
    "implicit": case("A [word].\n\n[word]: https://e.com\n", ["A [word].", "[word]: https://e.com"]),
    "no links in code": case("```\n[word](https://e.com)\n```\n", ["[word](https://e.com)"], ["[1]"]),
    "no links in spans": case("See `[word](https://e.com)` there.\n", ["`[word](https://e.com)`"], ["[1]"]),
    "numbers in use": case("A [word][1] and [x](https://b.com).\n\n[1]: https://a.com\n", ["[word][1]", "[x][2]", "[1]: https://a.com\n[2]: https://b.com\n"]),
    "spaces replaced": case("Many  spaces   here.\n", ["Many spaces here."], ["  "], Options(replacements=(SPACES,))),
    "groups replaced": case("At 1.2 and 3.4 now.\n", ["At 2.1 and 4.3 now."], [], Options(replacements=(VERSION,))),
    "after replaced": case("Go to http://e.com soon.\n", ["https://e.com"], ["http://"], Options(replacements=(HTTPS,))),
    "all three replaced": case("At 1.2 from http://e.com.  Two  spaces.\n", ["At 2.1 from https://e.com. Two spaces."], [], Options(replacements=(SPACES, VERSION, HTTPS))),
    "several lines replaced": case("[quote]\nOne\nTwo\n[/quote]\n", ["> One"], ["[quote]", "[/quote]"], Options(replacements=(QUOTE,))),
    "tags replaced": case("[b]Head[/b]\n\n[table]\nA row\n[/table]\n", ["## Head"], ["[b]", "[/b]", "[table]", "[/table]"], Options(replacements=(HEADS, GRID))),
    "code not replaced": case("An alpha.\n\n```\nalpha\n```\n\nMore alpha.\n", ["An omega.", "```\nalpha\n```", "More omega."], [], Options(replacements=(WORD,))),
    "code replaced": case("An alpha.\n\n```\nalpha\n```\n", ["An omega.", "```\nomega\n```"], [], Options(replacements=(WORD_IN_CODE,))),
    "late rules wait": case("An alpha.\n", ["An alpha."], ["omega"], Options(replacements=(Replacement("w", "(?s)alpha\\n\\n\\n", "omega"),))),
    "tags": case("Go {%tag%} on\n\n{%  tag   a=b  %}\n\n{%-tag-%} `{%x%}`\n", ["{% tag %}", "{% tag a=b %}", "{%- tag -%}", "`{%x%}`"]),
    "attributes": case("A {:.tip} `{:.x}`\n\n{:   #id   .class }\n", ["{: .tip }", "{: #id .class }", "`{:.x}`"]),
    "short and long rows": case("| a | b |\n|---|---|\n| 1 |\n| 2 | 3 | 4 |\n", exact="| a | b |\n|:--|:--|\n| 1 |   |\n| 2 | 3 |\n\n"),
    "one line with a pipe": case("just one | line with a pipe that is longer than the width of sixty characters\n", exact="just one | line with a pipe that is longer than the width of sixty characters\n\n"),
    "only definitions": case("[a]: https://e.com\n", exact="\n"),
    "number guard": case("A line of words that is so long that it ends at chapter no. 12. and goes on\n", ["no. 12. and goes on"], ["\n12."]),
}


def test_cases(spark):
    """One run for each set of options."""
    groups = {}
    for name, (text, *_, options, _) in CASES.items():
        groups.setdefault(options, []).append((name, text))

    def run(group):
        options, rows = group
        return {r.doc_id: r.text for r in normalize(spark.createDataFrame(rows, "doc_id string, text string"), options).collect()}

    with ThreadPoolExecutor(4) as pool:  # planning waits for the JVM most of its time
        got = {name: text for found in pool.map(run, groups.items()) for name, text in found.items()}
    assert got.keys() == CASES.keys()
    for name, (_, has, lacks, _, exact) in CASES.items():
        assert [h for h in has if h not in got[name]] == [], (name, got[name])
        assert [h for h in lacks if h in got[name]] == [], (name, got[name])
        assert exact is None or got[name] == exact, name


def test_rows_are_documents(spark):
    """Null and repeated ids, equal rows, an extra column: a row comes back for each."""
    rows = [(None, "hello  world"), (None, None), (1, "a\nb"), (1, "c\nd"), (1, "a\nb"), (2, None), (3, "")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string")
    got = sorted(((r.doc_id, r.text, r.changed) for r in normalize(df).collect()), key=repr)
    want = [(None, "hello  world\n\n", True), (None, None, False), (1, "a\nb\n\n", True), (1, "c\nd\n\n", True), (1, "a\nb\n\n", True), (2, None, False), (3, "\n", True)]
    assert got == sorted(want, key=repr)
    again = spark.createDataFrame([(1, "a\n\n"), (1, "b [x](http://y)\n")], "doc_id long, text string")
    assert sorted((r.text, r.changed) for r in normalize(again).collect()) == [("a\n\n", False), ("b [x][1]\n\n[1]: http://y\n\n", True)]
    assert normalize(df.limit(0)).collect() == []


def test_line_table_function(spark):
    """The SQL function names lines as the plan does."""
    from pyspark.sql import functions as F

    from quillspark.functions.tables import register
    from quillspark.operators.classify import display_math, regions
    from quillspark.operators.lines import to_lines
    from quillspark.plans.normalize import kinds
    from quillspark.plans.queries import only

    texts = ["---\na: b\n---\n# h\n\n- x\n> q\n***\n[a]: b\n| a |\n| b |\n\na | b\n```py\ncode\n```\n$$\nx\n$$\nend", "---\nno end", "", None, "x\n...\n~~~\n---"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.createOrReplaceTempView("some_docs")
    register(spark)
    got = sorted(map(tuple, spark.sql("SELECT d.doc_id, x.n, x.kind, x.l FROM some_docs d, LATERAL md_lines(d.text) x").collect()))
    lines = display_math(regions(to_lines(docs))).withColumn("raw", F.col("l"))
    assert got == sorted(map(tuple, kinds(lines, only(22)).select("doc_id", "n", "kind", "l").filter("doc_id <> 2").collect()))


def test_configuration(tmp_path, monkeypatch, spark):
    from quillspark.plans.options import load_replacements, read_config, resolve

    monkeypatch.chdir(tmp_path)
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "xdg"))
    folder = tmp_path / "xdg" / "quillspark"
    folder.mkdir(parents=True)
    assert read_config() == {} and load_replacements({}) == []
    (folder / "config.yaml").write_text("width: 90\noverwrite: true\nkeep_unreferenced: true\n")
    assert read_config() == {"width": 90, "overwrite": True, "keep_unreferenced": True}
    o = resolve(read_config())
    assert o.overwrite and o.keep_unreferenced and o.width == 90 and resolve({}, overwrite=True).overwrite
    (folder / "config.yml").write_text("width: 80\n")
    (tmp_path / ".quillspark.yml").write_text("width: [")  # not YAML: passed over
    assert read_config() == {"width": 80}
    (tmp_path / ".quillspark.yml").write_text("width: 70\n")
    assert read_config() == {"width": 70}
    one = "replacements:\n  - {name: %s, pattern: 'a', replacement: 'b'}\n  - {name: bad, pattern: '(', replacement: 'b'}\n"
    names = lambda *a, **k: [r.name for r in load_replacements(*a, **k)]
    (folder / "replacements.yml").write_text(one % "user")
    assert names({})[0] == "user"
    (tmp_path / ".quillspark-replacements.yml").write_text(one % "here")
    (tmp_path / "named.yml").write_text(one % "named")
    (tmp_path / "given.yml").write_text(one % "given")
    assert names({})[0] == "here"
    assert names({"replacements_file": "named.yml"})[0] == "named"
    assert names({"replacements_file": "named.yml"}, given="given.yml")[0] == "given"
    assert names({"replacements": False}) == [] and names({"replacements": False}, wanted=True)[0] == "here" and names({}, wanted=False) == []
    with pytest.warns(UserWarning, match="bad"):
        assert names({}, spark=spark) == ["here"]


def test_files_are_rewritten(spark, tmp_path):
    from quillspark.sources.files import overwrite_files, read_folder, read_stream_text

    (tmp_path / "a b.md").write_text("#A\n")
    (tmp_path / "c.md").write_text("done\n\n")
    summary = overwrite_files(normalize(read_folder(spark, str(tmp_path)))).first()
    assert summary.modified == 1 and (tmp_path / "a b.md").read_text() == "# A\n\n" and (tmp_path / "c.md").read_text() == "done\n\n"
    assert sorted(p.name for p in tmp_path.glob("*.md*")) == ["a b.md", "c.md"]
    assert [r.text for r in read_stream_text(spark, "plain words\nand more").collect()] == ["plain words\nand more"]
    assert [r.text for r in read_stream_text(spark, f"{tmp_path}/c.md\n").collect()] == ["done\n\n"]


def test_many_matches_stay_linear(spark):
    import time

    from pyspark.sql import functions as F

    from quillspark.functions.kernels import spans
    from quillspark.functions.rules import bold

    n = 20_000
    df = spark.createDataFrame([("**a** " * n,)], "l string")
    began = time.time()
    text, found = df.select(bold(F.col("l")), F.size(spans(F.col("l"), r"\*\*a"))).first()
    assert text == "__a__ " * n and found == n and time.time() - began < 30
