"""Named queries over the test tables, each beside the SQL that says the same.

The tables hold little markdown, so most queries first make some from their columns, by an
expression that both dialects read alike; the operator and the SQL then part ways.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import lines as P
from quillspark.functions import rules as R
from quillspark.operators import emoji, lists, tables, wrap
from quillspark.operators import links as L
from quillspark.operators.classify import display_math, regions
from quillspark.operators.lines import assemble, to_lines
from quillspark.operators.replacements import Replacement, by_line
from quillspark.plans.normalize import normalize
from quillspark.plans.options import CATALOGUE, Options

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def source(name: str, **columns: str):
    """A table's columns by expression: as a DataFrame and as SQL."""
    sql = f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {name}"
    return (lambda spark, d: spark.read.parquet(f"{d}/{name}.parquet").selectExpr(*[f"{e} AS {c}" for c, e in columns.items()])), sql


def only(*rules: int, **more) -> Options:
    return Options(skip=frozenset(set(CATALOGUE) - set(rules)), **more)


# ------------------------------------------------------------ rules of one line


def line_rule(name: str, table: str, key: str, expr: str, rule: Callable[[Column], Column], sql: str) -> None:
    rows, src = source(table, doc_id=key, l=expr)
    add(name, lambda s, d: rows(s, d).select("doc_id", rule(F.col("l")).alias("l")), f"SELECT doc_id, {sql} AS l FROM ({src})")


def splice_sql(pattern: str, new: str, source_sql: str) -> str:
    """A callback-style rewrite in SQL: ``new`` may use h (match), b and a (neighbours)."""
    b = "CASE WHEN g[i] <> '' THEN right(g[i], 1) WHEN i > 1 THEN right(m[i - 1], 1) ELSE '' END"
    a = "CASE WHEN coalesce(g[i + 1], '') <> '' THEN left(g[i + 1], 1) WHEN i < len(m) THEN left(m[i + 1], 1) ELSE '' END"
    one = new.replace("{h}", "m[i]").replace("{b}", f"({b})").replace("{a}", f"({a})")
    return f"""SELECT doc_id, array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || CASE WHEN i <= len(m) THEN {one} ELSE '' END), '') AS l
FROM (SELECT doc_id, string_split_regex(l, '{pattern}') AS g, regexp_extract_all(l, '{pattern}') AS m FROM ({source_sql}))"""


K = "o_orderkey"
line_rule("r01_line_endings", "orders", K, f"o_orderpriority || chr(13) || chr(10) || o_orderstatus || chr(13) || CASE WHEN {K} % 2 = 0 THEN chr(10) ELSE '' END", R.line_endings, r"CASE WHEN ends_with(regexp_replace(l, '\r\n?', chr(10), 'g'), chr(10)) THEN regexp_replace(l, '\r\n?', chr(10), 'g') ELSE regexp_replace(l, '\r\n?', chr(10), 'g') || chr(10) END")
line_rule("r02_trailing", "orders", K, f"o_orderpriority || repeat(' ', CAST({K} % 5 AS INT))", R.trailing, r"CASE WHEN regexp_matches(l, '(^|[^ ])  $') THEN l ELSE regexp_replace(l, '\s+$', '') END")
line_rule("r04_header_spacing", "customer", "c_custkey", "repeat('#', CAST(1 + c_custkey % 3 AS INT)) || repeat(' ', CAST(c_custkey % 4 AS INT)) || c_name", R.header_spacing, r"regexp_replace(l, '^(#+)\s*(.*)$', '\1 \2')")
line_rule("r13_list_marker", "orders", K, f"repeat(' ', CAST({K} % 3 AS INT)) || CASE WHEN {K} % 2 = 0 THEN '- ' ELSE '12. ' END || repeat(' ', CAST({K} % 4 AS INT)) || o_orderpriority", R.list_marker, r"regexp_replace(l, '^(\s*)([-*+]|\d+\.)\s+(.*)$', '\1\2 \3')")
line_rule("r16_ial_spacing", "part", "p_partkey", "'{' || CASE WHEN p_partkey % 2 = 0 THEN ':' ELSE '' END || repeat(' ', CAST(p_partkey % 3 AS INT)) || '.c' || p_size || '  #id' || repeat(' ', CAST(p_partkey % 4 AS INT)) || '} and `{:  x}`'", R.ial_spacing, r"CASE WHEN starts_with(l, '{:') THEN regexp_replace(l, '^\{:\s*(\S+)\s+(#id)\s*\}', '{: \1 \2 }') ELSE regexp_replace(l, '^\{\s*(\S+)\s+(#id)\s*\}', '{\1 \2}') END")
line_rule("r17_code_language", "orders", K, f"CASE WHEN {K} % 2 = 0 THEN '```' ELSE '~~~' END || repeat(' ', CAST({K} % 3 AS INT)) || lower(o_orderstatus)", R.code_language, r"regexp_replace(l, '^(`{3}|~{3})\s+([^\s`~]+)', '\1\2')")
line_rule("r18_definition_spacing", "supplier", "s_suppkey", "'[s' || s_suppkey || ']' || repeat(' ', CAST(s_suppkey % 3 AS INT)) || ':' || repeat(' ', CAST(s_suppkey % 4 AS INT)) || 'http://x/' || s_name", R.definition_spacing, r"regexp_replace(l, '^(\[[^\]]+\])\s*:\s*', '\1: ')")
line_rule("r19_task_checkbox", "orders", K, f"'-  [' || CASE WHEN {K} % 3 = 0 THEN 'X' WHEN {K} % 3 = 1 THEN 'x' ELSE ' ' END || ']  ' || o_orderpriority", R.task_checkbox, r"regexp_replace(l, '^(\s*[-*+])\s+\[[Xx]\]\s+', '\1 [x] ')")
line_rule("r20_quote_spacing", "conversations", "conv_id * 1000 + turn", "repeat('>', CAST(1 + turn % 3 AS INT)) || CASE WHEN turn % 2 = 0 THEN ' ' ELSE '' END || role", R.quote_spacing, r"regexp_replace(l, '^(\s*)(>+)([^\s>])', '\1\2 \3')")
line_rule("r21_inline_math", "part", "p_partkey", "'a $ x' || p_size || ' $ b $$ y $$ for $5 or $ 6 '", R.inline_math, r"regexp_replace(regexp_replace(l, '\$\$\s*(.*?)\s*\$\$', '$$\1$$'), '\$ (x\d+) \$', '$\1$')")
line_rule("r24_typography", "customer", "c_custkey", "'“' || c_name || '”–—…«' || c_mktsegment || '»’'", R.typography, "replace(replace(replace(translate(l, chr(8220) || chr(8221) || chr(8216) || chr(8217) || chr(171) || chr(187), '\"\"' || chr(39) || chr(39) || '\"\"'), chr(8211), '--'), chr(8212), '---'), chr(8230), '...')")
line_rule("r31_liquid_tags", "orders", K, f"'{{%' || CASE WHEN {K} % 2 = 0 THEN '-' ELSE '' END || repeat(' ', CAST({K} % 3 AS INT)) || 'if x' || {K} || '%}} y {{%endif  %}}'", R.liquid_tags, r"regexp_replace(l, '\{%(-?)\s*(.*?)\s*(-?)%\}', '{%\1 \2 \3%}', 'g')")
line_rule("r32_quote_markers", "conversations", "conv_id * 1000 + turn", "'>' || repeat(' >', CAST(turn % 4 AS INT)) || repeat(' ', CAST(turn % 2 AS INT)) || role", R.quote_markers, r"replace(regexp_extract(l, '^(>(?:\s*>)*)', 1), ' ', '') || regexp_extract(l, '^>(?:\s*>)*(.*)$', 1)")

_bold_rows, _bold_src = source("part", doc_id="p_partkey", l="'**' || p_name || '** and **' || p_brand || '**' || CASE WHEN p_partkey % 3 = 0 THEN '_' WHEN p_partkey % 3 = 1 THEN '*' ELSE '' END || ' ' || p_type || ' **open'")
add("r25_bold", lambda s, d: _bold_rows(s, d).select("doc_id", R.bold(F.col("l")).alias("l")), splice_sql(r"\*\*.+?\*\*", "CASE WHEN {b} = '*' OR {a} = '_' OR (substr({h}, 3, 1) = '*' AND {a} = '*') THEN {h} ELSE '__' || substr({h}, 3, length({h}) - 4) || '__' END", _bold_src))
_it_rows, _it_src = source("part", doc_id="p_partkey", l="'_' || p_name || '_ ' || replace(p_type, ' ', '_') || CASE WHEN p_partkey % 2 = 0 THEN ' _' ELSE '' END || ' x _it_ _' || p_brand || '_.'")
add("r25_italic", lambda s, d: _it_rows(s, d).select("doc_id", R.italic(F.col("l")).alias("l")), splice_sql("_[^_]+?_", "CASE WHEN regexp_matches({b}, '[A-Za-z0-9_]') OR regexp_matches({a}, '[A-Za-z0-9_]') THEN {h} ELSE '*' || substr({h}, 2, length({h}) - 2) || '*' END", _it_src))
_st_rows, _st_src = source("part", doc_id="p_partkey", l="CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN '***' WHEN 1 THEN '**_' WHEN 2 THEN '_**' ELSE '___' END || p_name || CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN '***' WHEN 1 THEN '_**' WHEN 2 THEN '***' ELSE '___' END || ' ' || p_type")
add("r25_bold_and_italic", lambda s, d: _st_rows(s, d).select("doc_id", R.strong_emphasis(F.col("l")).alias("l")), splice_sql("[_*]{3}.+?[_*]{3}", "CASE WHEN right({h}, 3) <> reverse(left({h}, 3)) THEN {h} ELSE '__*' || substr({h}, 4, length({h}) - 6) || '*__' END", _st_src))
_r25_sql = splice_sql(r"\*\*.+?\*\*", "CASE WHEN {b} = '*' OR {a} = '_' OR (substr({h}, 3, 1) = '*' AND {a} = '*') THEN {h} ELSE '__' || substr({h}, 3, length({h}) - 4) || '__' END", "SELECT {doc_id: doc_id, n: n} AS doc_id, l FROM (SELECT doc_id, m, n, l FROM (SELECT doc_id, len(string_split(text, chr(10))) AS m, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents) WHERE NOT (l = '' AND n = m - 1))")
add("r25_documents", lambda s, d: to_lines(s.read.parquet(f"{d}/documents.parquet")).select("doc_id", "n", R.bold(F.col("l")).alias("l")), _r25_sql.replace("SELECT doc_id, array", "SELECT doc_id.doc_id AS doc_id, doc_id.n::INT AS n, array", 1))
_chain_rows, _chain_src = source("part", doc_id="p_partkey", l="'**' || p_name || '** a _' || p_brand || '_ b ***' || p_type || '*** c_d_e __' || p_size || '__ *' || p_name || '* ' || CASE CAST(p_partkey % 3 AS INT) WHEN 0 THEN '_open' WHEN 1 THEN '*x' ELSE '**_y_**' END")
_BOTH = ("[_*]{3}.+?[_*]{3}", "CASE WHEN right({h}, 3) <> reverse(left({h}, 3)) THEN {h} ELSE '%s' || substr({h}, 4, length({h}) - 6) || '%s' END")
_WORD = "regexp_matches({b}, '[A-Za-z0-9_]') OR regexp_matches({a}, '[A-Za-z0-9_]')"
_chain = splice_sql(_BOTH[0], _BOTH[1] % ("__*", "*__"), _chain_src)
_chain = splice_sql(r"\*\*.+?\*\*", "CASE WHEN {b} = '*' OR {a} = '_' OR (substr({h}, 3, 1) = '*' AND {a} = '*') THEN {h} ELSE '__' || substr({h}, 3, length({h}) - 4) || '__' END", _chain)
_chain = splice_sql("_[^_]+?_", f"CASE WHEN {_WORD} THEN {{h}} ELSE '*' || substr({{h}}, 2, length({{h}}) - 2) || '*' END", _chain)
add("r25_all_passes", lambda s, d: _chain_rows(s, d).select("doc_id", R.bold_italic(F.col("l")).alias("l")), _chain)
_back = splice_sql(_BOTH[0], _BOTH[1] % ("_**", "**_"), _chain_src)
_back = splice_sql("__[^_]+?__", f"CASE WHEN {_WORD} THEN {{h}} ELSE '**' || substr({{h}}, 3, length({{h}}) - 4) || '**' END", _back)
_back = splice_sql(r"\*[^*]+?\*", "CASE WHEN {b} = '*' OR {a} = '*' THEN {h} ELSE '_' || substr({h}, 2, length({h}) - 2) || '_' END", _back)
add("r25_reversed", lambda s, d: _chain_rows(s, d).select("doc_id", R.reversed_emphasis(F.col("l")).alias("l")), _back)

# ---------------------------------------------------------------- emoji names

_names = ", ".join(f"({i}, '{n}')" for i, n in enumerate(emoji.COMMON_NAMES))


def _emoji(spark: SparkSession, d: str) -> DataFrame:
    words = spark.read.parquet(f"{d}/events.parquet").selectExpr("event_type || CAST(event_id % 7 AS STRING) AS name").unionByName(spark.read.parquet(f"{d}/part.parquet").selectExpr("split(p_name, ' ')[0] AS name"))
    return emoji.corrections(words, emoji.dictionary(spark))


add("r23_emoji_names", _emoji, rf"""
WITH k(idx, known) AS (VALUES {_names}),
w AS (SELECT DISTINCT event_type || CAST(event_id % 7 AS VARCHAR) AS name FROM events UNION SELECT split_part(p_name, ' ', 1) FROM part),
c AS (SELECT name, known, idx, levenshtein(replace(lower(name), '-', '_'), known) AS far FROM w, k)
SELECT name, arg_min(known, far * 1000000 + length(known) * 1000 + idx) AS fix FROM c WHERE far <= 4 GROUP BY name""")

# ------------------------------------------------------------------ line tables

_doc_lines = "SELECT doc_id, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS n, unnest(string_split(text, chr(10))) AS l FROM documents"
add("line_table", lambda s, d: to_lines(s.read.parquet(f"{d}/documents.parquet")), f"SELECT * FROM ({_doc_lines}) t WHERE NOT (l = '' AND n = (SELECT len(string_split(text, chr(10))) - 1 FROM documents x WHERE x.doc_id = t.doc_id))")
add("line_lengths", lambda s, d: to_lines(s.read.parquet(f"{d}/documents.parquet")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.max(F.length("l")).alias("longest"), F.sum((F.length("l") > 60).cast("int")).alias("over")), f"SELECT doc_id, count(*) AS lines, max(length(l))::INT AS longest, sum((length(l) > 60)::INT)::BIGINT AS over FROM ({_doc_lines}) t WHERE NOT (l = '' AND n = (SELECT len(string_split(text, chr(10))) - 1 FROM documents x WHERE x.doc_id = t.doc_id)) GROUP BY doc_id")
add("round_trip", lambda s, d: assemble(to_lines(s.read.parquet(f"{d}/documents.parquet")).select("doc_id", "n", F.array("l").alias("frags"))), "SELECT doc_id, CASE WHEN ends_with(text, chr(10)) THEN text ELSE text || chr(10) END AS text FROM documents")

_forms = ["'```'", "''", f"'- item ' || {K}", "'  - sub'", "'3. num'", "'# Head'", "'text'", "'> quote'", "'***'", "''", "'    * deep'", "'para two'", "''", "'$$'", "'1. one'", "': def'", "'| a | b |'", "'|c|dd|'", "'Term'"]


def synthetic(*forms: int):
    """Lines of made-up documents, a document for each customer, from chosen forms."""
    picked = [_forms[f] for f in forms]
    case = f"CASE CAST((({K} * 7919) % 10007) % {len(picked)} AS INT) " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(picked)) + " END"
    return source("orders", doc_id="o_custkey", n=f"CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY {K}) - 1 AS INT)", l=case)


_all_rows, _all_src = synthetic(*range(len(_forms)))
_flags = {"fence": (P.is_fence, r"^\s*(`{3}|~{3})"), "item": (P.is_list_item, r"^\s*([-*+]|\d+\.)(\s|$)"), "headline": (P.is_headline, r"^\s*#+(\s+\S|[^\s#])"), "rule": (P.is_rule, r"^\s*[-*_]{3,}\s*$"), "quote": (P.is_quote, r"^\s*>"), "definition_item": (P.is_deflist_item, r"^(?:\s*>)*\s*:(\s|$)"), "separator": (P.is_separator, r"^\s*[|: -]*\|[|: -]*\s*$")}
add("line_kinds", lambda s, d: _all_rows(s, d).select("doc_id", "n", *[f(F.col("l")).alias(k) for k, (f, _) in _flags.items()]), f"SELECT doc_id, n, {', '.join(f'regexp_matches(l, {chr(39)}{p}{chr(39)}) AS {k}' for k, (_, p) in _flags.items())} FROM ({_all_src})")
_odd_rows, _odd_src = source("orders", doc_id=K, l=f"CASE CAST({K} % 11 AS INT) WHEN 0 THEN '> > ' || o_orderpriority WHEN 1 THEN '  >' WHEN 2 THEN '>>  ' WHEN 3 THEN '[id]: http://x' WHEN 4 THEN 'a `b` ' || o_orderpriority WHEN 5 THEN '|x|' || o_orderstatus || '|' WHEN 6 THEN 'x|y' WHEN 7 THEN '   - item' WHEN 8 THEN '# h' WHEN 9 THEN '---' ELSE o_orderpriority END")
add("line_measures", lambda s, d: _odd_rows(s, d).select("doc_id", P.is_preserved(F.col("l")).alias("preserved"), P.is_quote_blank(F.col("l")).alias("quote_blank"), P.quote_depth(F.col("l")).alias("depth"), P.indent_of(F.col("l")).alias("indent"), P.column_count(F.col("l")).alias("columns"), P.in_code_span(F.col("l"), F.lit(4)).alias("in_code")), f"""
SELECT doc_id, regexp_matches(l, '^\\s*(`{{3}}|~{{3}})|^\\s*\\[[^\\]]*\\]:|^\\s*#|^\\s*[-*_]{{3,}}\\s*$|\\|') AS preserved, regexp_matches(l, '^(\\s*>)+\\s*$') AS quote_blank,
  CASE WHEN regexp_matches(l, '^\\s*>') THEN length(regexp_replace(regexp_extract(l, '^[\\s>]*'), '[^>]', '', 'g')) ELSE 0 END::INT AS depth,
  (length(l) - length(ltrim(l)))::INT AS indent, CASE WHEN starts_with(l, '|') THEN len(string_split(l, '|')) - 2 ELSE len(string_split(l, '|')) END::INT AS columns,
  (length(left(l, 4)) - length(replace(left(l, 4), '`', ''))) % 2 = 1 AS in_code FROM ({_odd_src})""")
add("scan_fences", lambda s, d: regions(_all_rows(s, d)).select("doc_id", "n", "in_code", F.coalesce("fence", F.lit("")).alias("fence")), f"""
SELECT doc_id, n, NOT f AND odd AS in_code, CASE WHEN f AND odd THEN 'close' WHEN f THEN 'open' ELSE '' END AS fence
FROM (SELECT doc_id, n, f, coalesce(sum(f::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS odd FROM (SELECT doc_id, n, starts_with(l, '```') AS f FROM ({_all_src})))""")
_fm_rows, _fm_src = source("orders", doc_id="o_custkey", n=f"CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY {K}) - 1 AS INT)", l=f"CASE WHEN {K} % 3 = 0 THEN '---' WHEN {K} % 7 = 1 THEN '...' WHEN {K} % 5 = 2 THEN '```' ELSE o_orderpriority END")
add("scan_front_matter", lambda s, d: regions(_fm_rows(s, d)).select("doc_id", "n", "in_fm", "in_code"), f"""
WITH t AS (SELECT *, max((n = 0 AND l = '---')::INT) OVER w = 1 AS o, min(n) FILTER (WHERE n > 0 AND l IN ('---', '...')) OVER w AS c FROM ({_fm_src}) WINDOW w AS (PARTITION BY doc_id)),
u AS (SELECT doc_id, n, l, o AND (c IS NULL OR n <= c) AS in_fm FROM t)
SELECT doc_id, n, in_fm, NOT in_fm AND l <> '```' AND coalesce(sum((l = '```' AND NOT in_fm)::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS in_code FROM u""")
_math_rows, _math_src = synthetic(13, 6, 11, 1)
add("scan_display_math", lambda s, d: display_math(regions(_math_rows(s, d))).select("doc_id", "n", F.coalesce("math", F.lit("")).alias("math")), f"""
SELECT doc_id, n, CASE WHEN l = '$$' AND odd THEN 'close' WHEN l = '$$' THEN 'open' WHEN odd THEN 'inside' ELSE '' END AS math
FROM (SELECT *, coalesce(sum((l = '$$')::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS odd FROM ({_math_src}))""")


# -------------------------------------------------- rules of neighbouring lines


def as_docs(lines: DataFrame) -> DataFrame:
    return assemble(lines.select("doc_id", "n", F.array("l").alias("frags")))


def block_rule(name: str, forms: tuple[int, ...], options: Options, before: str = "''", after: str = "''", keep: str = "true") -> None:
    """One rule over documents of a few forms; SQL puts text before and after lines."""
    rows, src = synthetic(*forms)
    add(name, lambda s, d: normalize(as_docs(rows(s, d)), options).select("doc_id", "text"), f"""
SELECT doc_id, string_agg({before} || l || {after}, chr(10) ORDER BY n) || chr(10) AS text
FROM (SELECT *, lag(l) OVER w AS prev, lead(l) OVER w AS nxt FROM ({src}) WINDOW w AS (PARTITION BY doc_id ORDER BY n)) WHERE {keep} GROUP BY doc_id""")


_nl = "chr(10)"
block_rule("r03_blank_lines", (6, 1, 5, 9, 12), only(3), keep="NOT (l = '' AND prev IS NOT NULL AND prev = '')")
block_rule("r05_header_newline", (5, 6, 1, 11), only(5), after=f"CASE WHEN l = '# Head' AND nxt <> '' AND nxt <> '# Head' THEN {_nl} ELSE '' END")
block_rule("r08_list_before", (2, 6, 1, 11), only(8, 9), before=f"CASE WHEN starts_with(l, '- ') AND prev IS NOT NULL AND prev <> '' AND NOT starts_with(prev, '- ') THEN {_nl} ELSE '' END", after=f"CASE WHEN starts_with(l, '- ') AND nxt <> '' AND NOT starts_with(nxt, '- ') THEN {_nl} ELSE '' END")
block_rule("r10_rule_blanks", (8, 6, 1), only(10, 11), before=f"CASE WHEN l = '***' AND prev IS NOT NULL AND prev <> '' AND prev <> '***' THEN {_nl} ELSE '' END", after=f"CASE WHEN l = '***' AND nxt <> '' THEN {_nl} ELSE '' END")
_code_rows, _code_src = synthetic(0, 6, 11)
add("r06_code_blanks", lambda s, d: normalize(as_docs(_code_rows(s, d)), only(6, 7)).select("doc_id", "text"), f"""
WITH t AS (SELECT *, l = '```' AS f, lead(l) OVER w AS nxt, lag(l) OVER w AS prev, coalesce(sum((l = '```')::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS odd FROM ({_code_src}) WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
u AS (SELECT *, f AND odd AND nxt IS NOT NULL AS after FROM t), v AS (SELECT *, coalesce(lag(after) OVER (PARTITION BY doc_id ORDER BY n), false) AS was FROM u)
SELECT doc_id, string_agg(CASE WHEN f AND NOT odd AND prev IS NOT NULL AND NOT was AND prev <> '```' THEN chr(10) ELSE '' END || l || CASE WHEN after THEN chr(10) ELSE '' END, chr(10) ORDER BY n) || chr(10) AS text FROM v GROUP BY doc_id""")
_tight_rows, _tight_src = synthetic(2, 3, 1, 9)
add("r33_compress_lists", lambda s, d: normalize(as_docs(_tight_rows(s, d)), only(33)).select("doc_id", "text"), f"""
WITH t AS (SELECT *, last_value(CASE WHEN l <> '' THEN n END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) IS NOT NULL AS item_above,
  first_value(CASE WHEN l <> '' THEN n END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) IS NOT NULL AS item_below FROM ({_tight_src}))
SELECT doc_id, string_agg(l, chr(10) ORDER BY n) || chr(10) AS text FROM t WHERE NOT (l = '' AND item_above AND item_below) GROUP BY doc_id""")
add("r15_end_newline", lambda s, d: normalize(s.read.parquet(f"{d}/documents.parquet").selectExpr("doc_id", "text || repeat(chr(10), CAST(doc_id % 4 AS INT)) AS text"), only(15)).select("doc_id", "text"), r"SELECT doc_id, regexp_replace(text, '\n\s*$', '') || chr(10) || chr(10) AS text FROM documents")
_def_rows, _def_src = synthetic(18, 1, 15)
add("r03_definition_lists", lambda s, d: normalize(as_docs(_def_rows(s, d)), only(3)).select("doc_id", "text"), f"""
WITH t AS (SELECT *, last_value(CASE WHEN l <> '' THEN l END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
  first_value(CASE WHEN l <> '' THEN l END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q, lag(l) OVER (PARTITION BY doc_id ORDER BY n) AS prev FROM ({_def_src}))
SELECT doc_id, string_agg(l, chr(10) ORDER BY n) || chr(10) AS text FROM t WHERE NOT (l = '' AND p IS NOT NULL AND coalesce(q, '') = ': def') AND NOT (l = '' AND coalesce(prev, 'x') = '') GROUP BY doc_id""")

_bm_rows, _bm_src = source("orders", doc_id="o_custkey", n=f"CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY {K}) - 1 AS INT)", l=f"CASE CAST((({K} * 7919) % 10007) % 4 AS INT) WHEN 0 THEN '$$' WHEN 1 THEN '  lead' WHEN 2 THEN 'trail  ' ELSE o_orderpriority END")
add("r21_block_math", lambda s, d: normalize(as_docs(_bm_rows(s, d)), only(21)).select("doc_id", "text"), f"""
WITH t AS (SELECT *, l = '$$' AS m, coalesce(sum((l = '$$')::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS odd FROM ({_bm_src})),
u AS (SELECT *, lead(l) OVER w AS nxt, lag(n) OVER w IS NOT NULL AS has_prev, coalesce(lag(m AND odd) OVER w, false) AS was_close, coalesce(lag(m AND NOT odd) OVER w, false) AS after_open, coalesce(lead(m AND odd) OVER w, false) AS before_close FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY n))
SELECT doc_id, string_agg(CASE WHEN m AND NOT odd AND has_prev AND NOT was_close THEN chr(10) ELSE '' END || CASE WHEN NOT m AND odd AND after_open THEN ltrim(l) WHEN NOT m AND odd AND before_close THEN rtrim(l) ELSE l END || CASE WHEN m AND odd AND nxt IS NOT NULL THEN chr(10) ELSE '' END, chr(10) ORDER BY n) || chr(10) AS text FROM u GROUP BY doc_id""")
_cb_rows, _cb_src = synthetic(0, 1, 6, 11)
add("code_trailing_blanks", lambda s, d: normalize(as_docs(_cb_rows(s, d)), only()).select("doc_id", "text"), f"""
WITH t AS (SELECT *, l = '```' AS f, coalesce(sum((l = '```')::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS odd,
  first_value(CASE WHEN l <> '' THEN l END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS q FROM ({_cb_src}))
SELECT doc_id, string_agg(CASE WHEN p = '```' AND NOT odd AND l IN ('text', 'para two') THEN chr(10) ELSE '' END || l, chr(10) ORDER BY n) || chr(10) AS text
FROM (SELECT *, lag(l) OVER (PARTITION BY doc_id ORDER BY n) AS p FROM t WHERE NOT (l = '' AND odd AND coalesce(q, '') = '```')) GROUP BY doc_id""")
_segs = [Replacement("join", r"text\npara two", "text, para two", "before"), Replacement("late", r"(?s)one(\n)", "1$1"), Replacement("code", "text", "TEXT", "before", in_code_blocks=True)]


def _segments_sql(rows: str, test: str, new: str) -> str:
    """A replacement over maximal runs of one region; ``rows`` has doc_id, n, l."""
    return f"""
SELECT doc_id, n, l FROM (SELECT doc_id, unnest(string_split(left(text, length(text) - 1), chr(10))) AS l, generate_subscripts(string_split(left(text, length(text) - 1), chr(10)), 1) - 1 AS n FROM (
  SELECT doc_id, string_agg(CASE WHEN {test} THEN {new} ELSE t END, '' ORDER BY seg) AS text FROM (
    SELECT doc_id, seg, any_value(code) AS code, string_agg(l, chr(10) ORDER BY n) || chr(10) AS t FROM (
      SELECT *, sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY n) AS seg FROM (
        SELECT *, coalesce(code <> lag(code) OVER (PARTITION BY doc_id ORDER BY n), true) AS cut FROM (
          SELECT *, coalesce(sum((l = '```')::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS code FROM ({rows}))))
    GROUP BY doc_id, seg) GROUP BY doc_id))"""


_seg_rows, _seg_src = synthetic(0, 6, 11, 14)
_seg_sql = _segments_sql(_seg_src, "NOT code", "replace(t, 'text' || chr(10) || 'para two', 'text, para two')")
_seg_sql = _segments_sql(_seg_sql, "true", "replace(t, 'text', 'TEXT')")
# a paragraph after a list item or a fence stands apart, whatever the rules
_seg_sql = f"""
WITH x AS ({_seg_sql}), y AS (SELECT *, lag(l) OVER w AS p, coalesce(sum((l = '```')::INT) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS code FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY n))
SELECT doc_id, 2 * n AS n, l FROM y UNION ALL SELECT doc_id, 2 * n - 1, '' FROM y WHERE NOT code AND l <> '```' AND l NOT LIKE '1.%' AND (p = '```' OR p LIKE '1.%')"""
_seg_sql = _segments_sql(_seg_sql, "NOT code", "replace(t, 'one' || chr(10), '1' || chr(10))")
add("replacements_documents", lambda s, d: normalize(as_docs(_seg_rows(s, d)), only(replacements=tuple(_segs))).select("doc_id", "text"), f"SELECT doc_id, string_agg(l, chr(10) ORDER BY n) || chr(10) AS text FROM ({_seg_sql}) GROUP BY doc_id")

# ----------------------------------------------------------------------- lists

_items, _items_src = source("lineitem", doc_id="l_orderkey", n="CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS INT)", l="repeat(' ', CAST(CASE WHEN l_linenumber = 1 THEN 0 ELSE 4 * (l_partkey % 3) END AS INT)) || CASE WHEN l_suppkey % 2 = 0 THEN '- ' ELSE '7. ' END || 'part ' || l_partkey")


def _numbered(s: SparkSession, d: str, keep: bool) -> DataFrame:
    rows = _items(s, d).withColumn("list", F.lit(True)).withColumn("run", F.lit(0)).withColumn("level", lists.level_of(F.col("l"), F.lit(4)))
    out = lists.numbering(rows.withColumn("follows", F.col("n") > 0).withColumn("wrapped_before", F.lit(False)), keep)
    return out.select("doc_id", "n", F.col("level").cast("int").alias("level"), "marker", "interrupt")


def _list_sql(start: str) -> str:
    return f"""
WITH a AS (SELECT doc_id, n, ((length(l) - length(ltrim(l, ' '))) // 4)::INT AS level, regexp_matches(l, '^\\s*\\d+\\.') AS num FROM ({_items_src})),
b AS (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY n) AS pl FROM a),
c AS (SELECT *, last_value(CASE WHEN level = 0 AND (pl IS NULL OR pl = 0) THEN num END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was FROM b),
e AS (SELECT *, coalesce(level = 0 AND pl = 0 AND num <> was, false) AS interrupt FROM c),
f AS (SELECT *, CASE WHEN level = 0 THEN sum(interrupt::INT) OVER w WHEN level = 1 THEN sum((level < 1)::INT) OVER w ELSE sum((level < 2)::INT) OVER w END AS ctx FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY n))
SELECT doc_id, n, level, CASE WHEN first(num) OVER w THEN ({start} + row_number() OVER w - 1)::VARCHAR || '.' WHEN level = 0 THEN '*' WHEN level = 1 THEN '-' ELSE '+' END AS marker, interrupt
FROM f WINDOW w AS (PARTITION BY doc_id, level, ctx ORDER BY n)"""


add("r26_list_numbers", lambda s, d: _numbered(s, d, False), _list_sql("1"))
add("r27_list_reset_off", lambda s, d: _numbered(s, d, True), _list_sql("CASE WHEN first(num) OVER w THEN 7 ELSE 1 END"))
add("r12_list_tabs", lambda s, d: _items(s, d).select("doc_id", "n", lists.tabs_for_spaces(F.col("l"), F.lit(4)).alias("l")), f"SELECT doc_id, n, repeat(chr(9), ((length(l) - length(ltrim(l, ' '))) // 4)::INT) || ltrim(l, ' ') AS l FROM ({_items_src})")

_run_rows, _run_src = synthetic(2, 3, 4, 1, 6, 10)


def _runs(s: SparkSession, d: str) -> DataFrame:
    l = F.col("l")
    rows = _run_rows(s, d).withColumn("list", P.is_list_item(l)).withColumn("clears", l == "text").withColumn("clears_after", P.is_list_item(l) & (F.col("n") % 5 == 4))
    return lists.indent_unit(lists.list_runs(rows)).select("doc_id", "n", F.col("run").cast("long").alias("run"), "unit")


add("list_runs_and_units", _runs, f"""
WITH t AS (SELECT *, regexp_matches(l, '^\\s*([-*+]|\\d+\\.)\\s') AS item, length(l) - length(ltrim(l)) AS lead FROM ({_run_src})),
r AS (SELECT *, (coalesce(sum((l = 'text')::INT) OVER (PARTITION BY doc_id ORDER BY n), 0) + coalesce(sum((item AND n % 5 = 4)::INT) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS run,
  sum((NOT item AND l <> '')::INT) OVER (PARTITION BY doc_id ORDER BY n) AS block, coalesce(lag(item) OVER (PARTITION BY doc_id ORDER BY n), false) AS above FROM t),
firsts AS (SELECT doc_id, run, min(n) AS n FROM r WHERE item GROUP BY ALL),
told AS (SELECT f.doc_id, f.run, arg_min(CASE WHEN x.lead >= 4 THEN 4 ELSE 2 END, x.n) AS unit FROM firsts f JOIN r ON r.doc_id = f.doc_id AND r.n = f.n
  JOIN r x ON x.doc_id = r.doc_id AND x.block = r.block AND x.item AND x.lead >= 2 AND (x.n > r.n OR (x.n = r.n AND r.above)) GROUP BY ALL)
SELECT r.doc_id AS doc_id, r.n AS n, r.run AS run, coalesce(told.unit, 2)::INT AS unit FROM r LEFT JOIN told ON told.doc_id = r.doc_id AND told.run = r.run""")

# ---------------------------------------------------------------------- tables

_table_rows, _table_src = source("nation", doc_id="n_regionkey", n="CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT)", l="'|' || n_name || '|' || n_nationkey || ' | x|'")
add("r22_table_format", lambda s, d: tables.format_tables(_table_rows(s, d).withColumn("tbl", F.lit(1))).select("doc_id", F.array_join("frags", "\n").alias("text")), f"""
WITH c AS (SELECT doc_id, n, ' ' || trim(string_split(trim(l, '|'), '|')[1]) || ' ' AS a, ' ' || trim(string_split(trim(l, '|'), '|')[2]) || ' ' AS b, ' ' || trim(string_split(trim(l, '|'), '|')[3]) || ' ' AS z FROM ({_table_src})),
w AS (SELECT doc_id, max(length(a)) AS wa, max(length(b)) AS wb, max(length(z)) AS wz FROM c GROUP BY doc_id),
r AS (SELECT doc_id, n * 2 AS n, '|' || rpad(a, wa::INT, ' ') || '|' || rpad(b, wb::INT, ' ') || '|' || rpad(z, wz::INT, ' ') || '|' AS l FROM c JOIN w USING (doc_id)
  UNION ALL SELECT doc_id, 1, '|:' || repeat('-', wa::INT - 2) || '-|:' || repeat('-', wb::INT - 2) || '-|:' || repeat('-', wz::INT - 2) || '-|' FROM w)
SELECT doc_id, string_agg(l, chr(10) ORDER BY n) AS text FROM r GROUP BY doc_id""")
_right_rows, _right_src = source("supplier", doc_id="s_nationkey", n="CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS INT)", l="s_name || ' | ' || s_suppkey")


def _right(s: SparkSession, d: str) -> DataFrame:
    rows = _right_rows(s, d)
    rule = rows.select("doc_id").distinct().select("doc_id", F.lit(0).alias("n"), F.lit(":-: | --:").alias("l"))
    return tables.format_tables(rows.unionByName(rule).withColumn("tbl", F.lit(1))).select("doc_id", F.array_join("frags", "\n").alias("text"))


add("r22_table_headerless", _right, f"""
WITH c AS (SELECT doc_id, n, ' ' || trim(string_split(l, '|')[1]) || ' ' AS a, ' ' || trim(string_split(l, '|')[2]) || ' ' AS b FROM ({_right_src})),
w AS (SELECT doc_id, max(length(a))::INT AS wa, max(length(b))::INT AS wb FROM c GROUP BY doc_id),
r AS (SELECT doc_id, n, '|' || repeat(' ', ((wa - length(a)) // 2)::INT) || a || repeat(' ', (wa - length(a) - (wa - length(a)) // 2)::INT) || '|' || lpad(b, wb, ' ') || '|' AS l FROM c JOIN w USING (doc_id)
  UNION ALL SELECT doc_id, 0, '|:' || repeat('-', wa - 2) || ':|-' || repeat('-', wb - 2) || ':|' FROM w)
SELECT doc_id, string_agg(l, chr(10) ORDER BY n) AS text FROM r GROUP BY doc_id""")
_rag_rows, _rag_src = source("supplier", doc_id="s_nationkey", n="CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INT)", l="CASE CAST(s_suppkey % 3 AS INT) WHEN 0 THEN '|' || s_name WHEN 1 THEN s_name || '|' || s_suppkey ELSE s_suppkey || ' | b | extra |' END")


def _ragged(s: SparkSession, d: str) -> DataFrame:
    rows = _rag_rows(s, d).withColumn("n", F.col("n") + 2)
    for n, l in ((0, "|A|B|"), (1, "|---|---|")):
        rows = rows.unionByName(rows.select("doc_id").distinct().select("doc_id", F.lit(n).alias("n"), F.lit(l).alias("l")))
    return normalize(as_docs(rows), only(22)).select("doc_id", "text")


add("r22_short_and_long_rows", _ragged, f"""
WITH c AS (SELECT doc_id, n + 2 AS n, string_split(regexp_replace(regexp_replace(trim(l), '^\\|', ''), '\\|$', ''), '|') AS p FROM ({_rag_src}) UNION ALL SELECT DISTINCT doc_id, 0, ['A', 'B'] FROM ({_rag_src})),
f AS (SELECT doc_id, n, ' ' || trim(p[1]) || ' ' AS a, CASE WHEN len(p) > 1 THEN ' ' || trim(p[2]) || ' ' ELSE ' ' END AS b FROM c),
w AS (SELECT doc_id, max(length(a))::INT AS wa, max(length(b))::INT AS wb FROM f GROUP BY doc_id),
r AS (SELECT doc_id, n, '|' || rpad(a, wa, ' ') || '|' || rpad(b, wb, ' ') || '|' AS l FROM f JOIN w USING (doc_id) UNION ALL SELECT doc_id, 1, '|:' || repeat('-', wa - 2) || '-|:' || repeat('-', wb - 2) || '-|' FROM w)
SELECT doc_id, string_agg(l, chr(10) ORDER BY n) || chr(10) AS text FROM r GROUP BY doc_id""")
_blk_rows, _blk_src = synthetic(16, 17, 6, 1)
add("table_blocks", lambda s, d: tables.table_blocks(_blk_rows(s, d), F.col("l").contains("|")).select("doc_id", "n", F.col("tbl").isNotNull().alias("in_table")), f"""
WITH t AS (SELECT *, l LIKE '%|%' AS p, n - row_number() OVER (PARTITION BY doc_id, l LIKE '%|%' ORDER BY n) AS island FROM ({_blk_src}))
SELECT doc_id, n, p AND count(*) OVER (PARTITION BY doc_id, p, island) >= 2 AS in_table FROM t""")

# ----------------------------------------------------------------------- links

_link_rows, _link_src = source("pages", doc_id="page_id % 50", n="CAST(row_number() OVER (PARTITION BY page_id % 50 ORDER BY page_id) - 1 AS INT)", l="'see [p' || page_id || '](' || split_part(url, '?', 1) || ') and [q](http://x.y/' || (page_id % 3) || ') end'")
_found = rf"""f AS (SELECT doc_id, n, 1 AS k, 'p' || regexp_extract(l, '\[p(\d+)\]', 1) AS text, regexp_extract(l, '\]\(([^)]*)\)', 1) AS url, strpos(l, '[p') - 1 AS s FROM ({_link_src})
  UNION ALL SELECT doc_id, n, 2, 'q', regexp_extract(l, '\[q\]\(([^)]*)\)', 1), strpos(l, '[q') - 1 FROM ({_link_src}))"""
add("link_extract", lambda s, d: L.find_links(regions(_link_rows(s, d))).select("doc_id", "n", "s", "text", "url", "kind"), f"WITH {_found} SELECT doc_id, n, s::INT AS s, text, url, 'inline' AS kind FROM f")


def _numbers(s: SparkSession, d: str) -> DataFrame:
    lines = regions(_link_rows(s, d))
    return L.number_links(L.resolve(L.find_links(lines), L.definitions(lines))).select("doc_id", "n", "s", F.col("num").cast("long").alias("num"))


_num_sql = f"{_found}, g AS (SELECT doc_id, url, min(n * 100000 + s) AS place FROM f GROUP BY 1, 2), h AS (SELECT doc_id, url, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS num FROM g)"
add("link_numbers", _numbers, f"WITH {_num_sql} SELECT doc_id, n, s::INT AS s, num FROM f JOIN h USING (doc_id, url)")
add("r28_reference_links", lambda s, d: as_docs(L.convert(_link_rows(s, d))), rf"""
WITH {_num_sql}, p AS (SELECT doc_id, n, max(num) FILTER (WHERE k = 1) AS a, max(num) FILTER (WHERE k = 2) AS b, max(text) FILTER (WHERE k = 1) AS t FROM f JOIN h USING (doc_id, url) GROUP BY 1, 2)
SELECT doc_id, string_agg('see [' || t || '][' || a || '] and [q][' || b || '] end', chr(10) ORDER BY n) || chr(10) || chr(10) || any_value(defs) || chr(10) AS text
FROM p JOIN (SELECT doc_id, string_agg('[' || num || ']: ' || url, chr(10) ORDER BY num) AS defs FROM h GROUP BY doc_id) USING (doc_id) GROUP BY doc_id""")
_ref_rows, _ref_src = source("supplier", doc_id="s_nationkey", n="CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INT)", l="CASE WHEN s_suppkey % 2 = 0 THEN '[k' || (s_suppkey % 6) || ']: http://s/' || s_suppkey || ' \"T\"' ELSE 'go [x][k' || (s_suppkey % 5) || '] or [K' || (s_suppkey % 4) || ']' END")
add("link_resolve", lambda s, d: (lambda t: L.resolve(L.find_links(t), L.definitions(t)))(regions(_ref_rows(s, d))).select("doc_id", "n", "s", "kind", "ref_id", "url", "title"), rf"""
WITH t AS ({_ref_src}),
d AS (SELECT doc_id, regexp_extract(l, '^\[([^\]]+)\]:', 1) AS id, arg_max(regexp_extract(l, '(http\S+)', 1), n) AS url FROM t WHERE l LIKE '[%' GROUP BY 1, 2),
u AS (SELECT doc_id, n, 3 AS s, 'reference' AS kind, regexp_extract(l, '\]\[([^\]]+)\]', 1) AS ref_id FROM t WHERE l LIKE 'go %'
  UNION ALL SELECT doc_id, n, strpos(l, '[K') - 1, 'implicit', lower(regexp_extract(l, '\[(K\d)\]', 1)) FROM t WHERE l LIKE 'go %')
SELECT doc_id, n, s::INT AS s, kind, ref_id, url, 'T' AS title FROM u JOIN d ON d.doc_id = u.doc_id AND d.id = u.ref_id""".replace("SELECT doc_id, n, s::INT", "SELECT u.doc_id AS doc_id, n, s::INT"))
_defs_sql = rf"""
t AS ({_ref_src}), d AS (SELECT doc_id, regexp_extract(l, '^\[([^\]]+)\]:', 1) AS id, arg_max(regexp_extract(l, '(http\S+)', 1), n) AS url FROM t WHERE l LIKE '[%' GROUP BY 1, 2),
u AS (SELECT t.doc_id AS doc_id, n, regexp_extract(l, '\]\[([^\]]+)\]', 1) AS a, regexp_extract(l, '\[(K\d)\]', 1) AS b FROM t WHERE l LIKE 'go %'),
v AS (SELECT u.*, x.url AS ax, y.url AS bx FROM u LEFT JOIN d x ON x.doc_id = u.doc_id AND x.id = u.a LEFT JOIN d y ON y.doc_id = u.doc_id AND y.id = lower(u.b))"""
add("r30_inline_links", lambda s, d: as_docs(L.convert(_ref_rows(s, d), inline=True)), f"""
WITH {_defs_sql}, w AS (SELECT doc_id, n, 'go [x]' || CASE WHEN ax IS NULL THEN '[' || a || ']' ELSE '(' || ax || ' "T")' END || ' or [' || b || ']' || CASE WHEN bx IS NULL THEN '' ELSE '(' || bx || ' "T")' END AS l FROM v)
SELECT doc_id, coalesce(string_agg(l, chr(10) ORDER BY n), '') || chr(10) AS text FROM (SELECT DISTINCT doc_id FROM t) LEFT JOIN w USING (doc_id) GROUP BY doc_id""")
_used_sql = "e AS (SELECT doc_id, a AS id, ax AS url, min(n * 10) AS pos FROM v WHERE ax IS NOT NULL GROUP BY ALL UNION ALL SELECT doc_id, lower(b), bx, min(n * 10 + 1) FROM v WHERE bx IS NOT NULL GROUP BY ALL), f AS (SELECT doc_id, id, any_value(url) AS url, min(pos) AS pos FROM e GROUP BY doc_id, id)"
_gone = "h AS (SELECT doc_id, id, url, 0 AS g, pos FROM f)"
_kept = "h AS (SELECT doc_id, id, url, 0 AS g, pos FROM f UNION ALL SELECT d.doc_id, d.id, d.url, 1, (SELECT max(n) FROM t WHERE t.doc_id = d.doc_id AND starts_with(t.l, '[' || d.id || ']:')) FROM d WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = d.doc_id AND f.id = d.id))"
for _name, _more, _keep in (("r28_named_references", _gone, False), ("keep_unreferenced", _kept, True)):
    add(_name, lambda s, d, k=_keep: as_docs(L.convert(_ref_rows(s, d), keep_unreferenced=k)), f"""
WITH {_defs_sql}, {_used_sql}, {_more}, b AS (SELECT doc_id, coalesce(string_agg(l, chr(10) ORDER BY n), '') AS body FROM (SELECT DISTINCT doc_id FROM t) LEFT JOIN (SELECT * FROM t WHERE l LIKE 'go %') USING (doc_id) GROUP BY doc_id),
g AS (SELECT doc_id, string_agg('[' || id || ']: ' || url || ' "T"', chr(10) ORDER BY h.g, pos) AS defs FROM h GROUP BY doc_id)
SELECT doc_id, body || chr(10) || CASE WHEN defs IS NULL THEN '' ELSE chr(10) || defs || chr(10) END AS text FROM b LEFT JOIN g USING (doc_id)""")
add("r29_links_at_beginning", lambda s, d: as_docs(L.convert(_link_rows(s, d), at_beginning=True)), rf"""
WITH {_num_sql}, p AS (SELECT doc_id, n, max(num) FILTER (WHERE k = 1) AS a, max(num) FILTER (WHERE k = 2) AS b, max(text) FILTER (WHERE k = 1) AS t FROM f JOIN h USING (doc_id, url) GROUP BY 1, 2)
SELECT doc_id, chr(10) || any_value(defs) || chr(10) || chr(10) || string_agg('see [' || t || '][' || a || '] and [q][' || b || '] end', chr(10) ORDER BY n) || chr(10) AS text
FROM p JOIN (SELECT doc_id, string_agg('[' || num || ']: ' || url, chr(10) ORDER BY num) AS defs FROM h GROUP BY doc_id) USING (doc_id) GROUP BY doc_id""")

# -------------------------------------------------------------------- wrapping

# the tables hold no back-ticks; a bracketed text with its target is one token; the word before a token
# like "3." comes along where that would start a line
_wrap_sql = r"""
WITH RECURSIVE t AS (SELECT doc_id, n, regexp_extract_all(l, '\[[^\[\]]*\]\([^)]*\)\S*|\S+') AS w FROM ({src}) WHERE length(l) > {width}),
r AS (
  SELECT doc_id, n, w, 1 AS i, 0 AS k, '' AS line, NULL::VARCHAR AS done FROM t
  UNION ALL
  SELECT doc_id, n, w, i + 1, CASE WHEN coalesce(d, '') <> '' THEN k + 1 ELSE k END, x, nullif(d, '') FROM (
    SELECT doc_id, n, w, i, k,
      CASE WHEN fits THEN ltrim(line || ' ' || w[i], ' ') WHEN guard THEN regexp_extract(line, '([^ ]*)$', 1) || ' ' || w[i] ELSE w[i] END AS x,
      CASE WHEN fits THEN NULL WHEN guard THEN regexp_replace(line, ' *[^ ]*$', '') ELSE line END AS d
    FROM (SELECT *, line = '' OR length(line) + 1 + length(w[i]) <= {width} AS fits, regexp_matches(w[i], '^\d+\.') AS guard FROM r WHERE i <= len(w))))
SELECT doc_id, n::INT AS n, k::INT AS k, line FROM (
  SELECT doc_id, n, k - 1 AS k, done AS line FROM r WHERE done IS NOT NULL
  UNION ALL SELECT doc_id, n, k, line FROM r WHERE i = len(w) + 1)
UNION ALL SELECT doc_id, n::INT, 0, l FROM ({src}) WHERE length(l) <= {width}"""


def _lines_sql(table: str, key: str) -> str:
    lines = f"SELECT {key} AS doc_id, len(string_split(text, chr(10))) AS m, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n, unnest(string_split(text, chr(10))) AS l FROM {table}"
    return f"SELECT doc_id, n, l FROM ({lines}) WHERE NOT (l = '' AND n = m - 1)"


def _wrapped(rows, width: int):
    return lambda s, d: rows(s, d).select("doc_id", "n", F.posexplode(wrap.wrap(F.col("l"), F.lit(width))).alias("k", "line"))


_b_rows = lambda s, d: to_lines(s.read.parquet(f"{d}/benchmark.parquet").selectExpr("item_id AS doc_id", "text"))
add("r14_wrap", _wrapped(_b_rows, 60), _wrap_sql.format(src=_lines_sql("benchmark", "item_id"), width=60))
_d_rows = lambda s, d: to_lines(s.read.parquet(f"{d}/documents.parquet"))
add("r14_wrap_documents", _wrapped(_d_rows, 60), _wrap_sql.format(src=_lines_sql("documents", "doc_id"), width=60))
_c_rows, _c_src = source("conversations", doc_id="conv_id * 1000 + turn", n="0", l="replace(text, chr(10), ' ') || ' see 12. and [a link text](http://x/' || conv_id || ') then 3. end'")
add("r14_wrap_tokens", _wrapped(_c_rows, 40), _wrap_sql.format(src=_c_src, width=40))

# ---------------------------------------------------------------- replacements

_swap = [Replacement("swap", r"(\w+)#(\d+)", "$2 of $1"), Replacement("digits", r"\d{4}", "<$0>", in_code_blocks=True), Replacement("none", "a(b)?c", "$2x$nope")]
_rep_rows, _rep_src = source("customer", doc_id="c_custkey", l="c_name || ' ' || CASE WHEN c_custkey % 3 = 0 THEN 'abc' ELSE 'ac' END", code="c_custkey % 4 = 0")
add("replacements", lambda s, d: _rep_rows(s, d).select("doc_id", by_line(F.col("l"), _swap, F.col("code"), F.lit(False)).alias("l")), rf"""
SELECT doc_id, CASE WHEN code THEN regexp_replace(l, '\d{{4}}', '<\0>', 'g') ELSE regexp_replace(regexp_replace(regexp_replace(l, '(\w+)#(\d+)', '\2 of \1', 'g'), '\d{{4}}', '<\0>', 'g'), 'a(b)?c', '', 'g') END AS l FROM ({_rep_src})""")

# ---------------------------------------------------------------- whole plans

add("normalize_full", lambda s, d: normalize(s.read.parquet(f"{d}/documents.parquet")))
add("normalize_synthetic", lambda s, d: normalize(as_docs(_all_rows(s, d))))
add("typography_documents", lambda s, d: s.read.parquet(f"{d}/documents.parquet").select("doc_id", R.typography(F.col("text")).alias("text")), "SELECT doc_id, replace(replace(replace(translate(text, chr(8220) || chr(8221) || chr(8216) || chr(8217) || chr(171) || chr(187), '\"\"' || chr(39) || chr(39) || '\"\"'), chr(8211), '--'), chr(8212), '---'), chr(8230), '...') AS text FROM documents")


def _changes(s: SparkSession, d: str) -> DataFrame:
    docs = s.read.parquet(f"{d}/documents.parquet")
    new = normalize(docs, only(1)).select("doc_id", "changed")
    return docs.select("doc_id", "source").join(new, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("changed").cast("int")).cast("long").alias("changed"))


add("changes_by_source", _changes, "SELECT source, count(*) AS documents, sum((NOT ends_with(text, chr(10)) OR contains(text, chr(13)))::INT)::BIGINT AS changed FROM documents GROUP BY source")
