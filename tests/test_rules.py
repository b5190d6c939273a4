"""Line rules and predicates on single lines."""

from pyspark.sql import functions as F

from quillspark.functions import kernels as K
from quillspark.functions import lines as P
from quillspark.functions import rules as R
from quillspark.operators.wrap import wrap

RULES = [
    (R.trailing, "a  ", "a  "),
    (R.trailing, "a   ", "a"),
    (R.trailing, "a \t", "a"),
    (R.header_spacing, "##Title", "## Title"),
    (R.header_spacing, "#   Title", "# Title"),
    (R.ial_spacing, "x {:   .a   #b}", "x {: .a #b }"),
    (R.ial_spacing, "x { .a  #b }", "x {.a #b}"),
    (R.ial_spacing, "`{:.a}` {:.a}", "`{:.a}` {: .a }"),
    (R.code_language, "```   py", "```py"),
    (R.definition_spacing, "[a]  :   http://x", "[a]: http://x"),
    (R.task_checkbox, "-   [X]   do", "- [x] do"),
    (R.task_checkbox, "- [ ]  do", "- [ ]  do"),
    (R.quote_spacing, ">>x", ">> x"),
    (R.quote_markers, "> > > x", ">>> x"),
    (R.quote_markers, "  >  x", "  >  x"),
    (R.list_marker, "  12.   x", "  12. x"),
    (R.inline_math, "a $ x $ and $$ y $$", "a $x$ and $$y$$"),
    (R.inline_math, "cost $5 and $6", "cost $5 and $6"),
    (R.typography, "“a” ‘b’ – — … «c»", "\"a\" 'b' -- --- ... \"c\""),
    (R.bold_italic, "**bold**", "__bold__"),
    (R.bold_italic, "an _italic_ word", "an *italic* word"),
    (R.bold_italic, "***both***", "__*both*__"),
    (R.bold_italic, "**_both_**", "__*both*__"),
    (R.bold_italic, "_my_file_name.md", "_my_file_name.md"),
    (R.bold_italic, "a_b _c_", "a_b _c_"),
    (R.bold_italic, "`**x**` **y**", "`**x**` __y__"),
    (R.bold_italic, ":heart_eyes_cat: _x_", ":heart_eyes_cat: *x*"),
    (R.reversed_emphasis, "__b__", "**b**"),
    (R.reversed_emphasis, "*i*", "_i_"),
    (R.liquid_tags, "{%tag%} `{%x%}` {%- if a  -%}", "{% tag %} `{%x%}` {%- if a -%}"),
    (R.liquid_tags, "{%  tag   a=b  %}", "{% tag   a=b %}"),
    (R.line_endings, "a\r\nb\rc", "a\nb\nc\n"),
]


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "l string").select(column(F.col("l"))).first()[0]


def test_rules(spark):
    """One query: a column for each case's rule, over its own text."""
    df = spark.range(1)
    got = df.select(*[rule(F.lit(text)).alias(f"c{k}") for k, (rule, text, _) in enumerate(RULES)]).first()
    assert list(got) == [want for _, _, want in RULES]


def test_predicates(spark):
    texts = ["- x", "-", "-x", "12. y", "#tag", "##", "# ", "## h", "***", "* * *", "> q", " >> q", "```", "  ~~~", "| --- |", "|||", ": d", ">: d", ":d", "", "١. x"]
    df = spark.createDataFrame([(t,) for t in texts], "l string")
    l = F.col("l")

    def of(p):
        return {r[0] for r in df.filter(p(l)).collect()}

    assert of(P.is_list_item) == {"- x", "-", "12. y", "* * *", "١. x"}
    assert of(P.is_headline) == {"#tag", "## h"}
    assert of(P.is_rule) == {"***"}
    assert of(P.is_fence) == {"```", "  ~~~"}
    assert of(P.is_separator) == {"| --- |", "|||"}
    assert of(P.is_deflist_item) == {": d", ">: d"}
    assert [r[0] for r in df.select(P.quote_depth(l)).collect()][10:12] == [1, 2]


def test_code_span_parity(spark):
    df = spark.createDataFrame([("a `b` c",)], "l string")
    assert df.select(*[P.in_code_span(F.col("l"), F.lit(k)) for k in (0, 3, 6)]).first()[:] == (False, True, False)


def test_template():
    assert K.java_template("$1-${2}", 2) == "$1-$2"
    assert K.java_template("$1text", 2) == ""
    assert K.java_template("a\\b", 0) == "a\\\\b"


def test_wrap(spark):
    def lines(text, width, prefix=None):
        return value(spark, lambda c: wrap(c, F.lit(width), None if prefix is None else F.lit(prefix)), text)

    assert lines("aaa bbb ccc", 7) == ["aaa bbb", "ccc"]
    assert lines("short", 20) == ["short"]
    assert lines("see [a link](http://x.y) now", 12) == ["see", "[a link](http://x.y)", "now"]
    assert lines("run `a b c d` now", 10) == ["run", "`a b c d`", "now"]
    assert lines("chapter two 3. ends", 12) == ["chapter", "two 3. ends"]
    assert lines("aaa bbb", 5, "> ") == ["> aaa", "> bbb"]
    assert lines("averyveryverylongword x", 5) == ["averyveryverylongword", "x"]
