"""URL filter: longest-prefix rules, then a character language-model ratio.

Two smoothed variable-order Markov models are trained on the URLs that the rules accept
and reject.  The probability of a character after a context of ``k`` characters mixes its
count there with the probability after ``k - 1``, down to a uniform one.  A URL's score is
the mean over its characters of the log ratio of the two models; the threshold lies midway
between the mean scores of accepted and rejected URLs that did not train.  Everything is DataFrame
code.

The table of n-grams is built over all URLs, so every gram to be scored has an entry and no
look-up can miss; lower orders are sums over that table, not over the URLs again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import discard, small_enough, stored, table

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
ORDER, PRIOR, CHUNK = 4, 2.0, 512
#: One in HELD_OUT URLs calibrates; the n-grams of the model that are sent to every task.
HELD_OUT, BROADCAST = 5, 20_000
START, END = "\x02", "\x03"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules=RULES) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, else null."""
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        h, slash, p = rule.partition("/")
        on_host = (host == h) | host.endswith(f".{h}")
        fits.append(F.when(on_host & path.startswith(slash + p), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits)


def grams_of(text: Column, order: int) -> Column:
    """For each character of ``text`` and an end mark: it and the ``order`` before it.

    Cut in chunks first: taking a substring costs what lies before it.
    """
    padded = F.concat(F.lit(START * order), text, F.lit(END))
    n = F.length(text) + 1
    starts = F.sequence(F.lit(0), n - 1, F.lit(CHUNK))

    def chunk(at: Column) -> Column:
        piece = F.substring(padded, at + 1, F.lit(CHUNK + order))
        return F.transform(F.sequence(F.lit(1), F.least(F.lit(CHUNK), n - at)), lambda i: F.substring(piece, i, F.lit(order + 1)))

    return F.flatten(F.transform(starts, chunk))


def ratio_table(grams: DataFrame, order: int = ORDER, prior: float = PRIOR) -> DataFrame:
    """``grams(gram, verdict)`` to ``(gram, llr, n)``: log of accepted over rejected probability, and
    how often the gram occurs."""
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(F.when(F.col("verdict") == v, 1).otherwise(0)).alias(n) for v, n in (("allow", "a"), ("block", "b"))]]
    full = stored(grams.groupBy("gram").agg(*sums), "url_grams")
    below = None
    for k in range(order + 1):
        rows = full.groupBy(F.substring("gram", order + 1 - k, k + 1).alias("g")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("n").alias("n"))
        context = rows.groupBy(F.substring("g", 1, k).alias("c")).agg(F.sum("a").alias("ca"), F.sum("b").alias("cb"), F.count(F.lit(1)).alias("kinds"))
        rows = rows.join(context, F.substring("g", 1, k) == F.col("c"))
        if below is None:
            rows = rows.withColumn("qa", 1 / F.col("kinds")).withColumn("qb", 1 / F.col("kinds"))
        else:
            rows = rows.join(below, F.substring("g", 2, k) == F.col("tail"))
        p = [((F.col(n) + prior * F.col("q" + n)) / (F.col("c" + n) + prior)).alias(f"p{n}") for n in "ab"]
        rows = rows.select("g", "n", *p)
        if k == order:
            return rows.select(F.col("g").alias("gram"), (F.ln("pa") - F.ln("pb")).alias("llr"), "n")
        below = rows.select(F.col("g").alias("tail"), F.col("pa").alias("qa"), F.col("pb").alias("qb"))
    raise AssertionError


def is_held_out(text: Column) -> Column:
    """URLs that calibrate the threshold and do not train: a fifth, by a hash of the text."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % HELD_OUT == 0


def mean_ratio(grams: DataFrame, model: DataFrame) -> DataFrame:
    """``grams(row, gram)`` to ``(row, score)``: the mean over each row's grams.

    The most frequent grams, which are nearly all that occur, are looked up in a table of
    ``BROADCAST`` rows sent to every task; only others meet the rest of the model in a shuffle, by row
    number and gram alone.  A row's grams are together, so that their sum is made before any shuffle.
    """
    if small_enough(model, BROADCAST):
        top, rest = model, None
    else:
        top = stored(model.orderBy(F.desc("n"), "gram").limit(BROADCAST), "url_top")
        rest = model.join(F.broadcast(top.select("gram")), "gram", "left_anti").select("gram", F.col("llr").alias("far"))
    known = grams.join(F.broadcast(top.select("gram", "llr")), "gram", "left")
    if rest is None:
        return known.groupBy("row").agg(F.round(F.avg("llr"), 9).alias("score"))
    near = known.groupBy("row").agg(F.sum("llr").alias("s"), F.count(F.lit(1)).alias("k"))
    far = known.filter("llr IS NULL").select("row", "gram").join(rest, "gram").groupBy("row").agg(F.sum("far").alias("s"), F.lit(0).cast("long").alias("k"))
    return near.unionByName(far).groupBy("row").agg(F.round(F.sum("s") / F.sum("k"), 9).alias("score"))


def judge(pages: DataFrame, rules=RULES, order: int = ORDER, prior: float = PRIOR) -> DataFrame:
    """``pages(page_id, url)`` to ``page_id, host, path, rule, verdict, score``.

    The model reads the whole URL as written, a null one as empty; the rules read host and
    path.  A null URL or one without ``://`` has both empty and is judged by the model.  A fifth of
    the accepted and rejected URLs does not train: the threshold lies midway between the mean scores
    of its two classes, or of all of a class that has none there; with a class missing altogether it
    is 0.  A score at the threshold is allowed.  Rows that repeat are judged alike; other columns are
    ignored; an empty table gives an empty result.
    """
    parsed = pages.select(F.col("page_id").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.coalesce("url", F.lit("")).alias("text"))
    parsed = parsed.withColumn("hit", match_rule(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "hit.rule", "hit.verdict", "text")
    parsed = stored(parsed.withColumn("held", is_held_out(F.col("text"))).withColumn("row", F.monotonically_increasing_id()), "urls")
    grams = parsed.select("row", F.when(~F.col("held"), F.col("verdict")).alias("verdict"), F.explode(grams_of(F.col("text"), order)).alias("gram"))
    model = stored(ratio_table(grams, order, prior), "url_ratios")
    scores = stored(mean_ratio(grams.select("row", "gram"), model), "url_scores")
    scored = parsed.drop("text").join(scores, "row")
    means = scored.filter("verdict IS NOT NULL").groupBy("verdict").agg(F.coalesce(F.avg(F.when(F.col("held"), F.col("score"))), F.avg("score")).alias("m")).collect()
    mean = {r.verdict: r.m for r in means}
    bar = (mean["allow"] + mean["block"]) / 2 if len(mean) == 2 else 0.0
    discard(model)
    verdict = F.coalesce("verdict", F.when(F.col("score") >= F.lit(round(bar, 9)), "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``judge`` of ``pages``."""
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _order_sql(k: int) -> str:
    """SQL of one order of the models, from the table of full n-grams."""
    lower = f"1.0 / kinds AS qa, 1.0 / kinds AS qb FROM r{k} JOIN c{k} ON c = substr(g, 1, {k})" if k == 0 else f"p{k - 1}.pa AS qa, p{k - 1}.pb AS qb FROM r{k} JOIN c{k} ON c = substr(g, 1, {k}) JOIN p{k - 1} ON p{k - 1}.g = substr(r{k}.g, 2, {k})"
    return f"""
r{k} AS (SELECT substr(gram, {ORDER + 1 - k}, {k + 1}) AS g, sum(a) AS a, sum(b) AS b FROM full_grams GROUP BY 1),
c{k} AS (SELECT substr(g, 1, {k}) AS c, sum(a) AS ca, sum(b) AS cb, count(*) AS kinds FROM r{k} GROUP BY 1),
p{k} AS (SELECT g, (a + {PRIOR} * qa) / (ca + {PRIOR}) AS pa, (b + {PRIOR} * qb) / (cb + {PRIOR}) AS pb FROM (SELECT r{k}.g AS g, a, b, ca, cb, {lower}))"""


OP10_SQL = rf"""
WITH u AS (
  SELECT row_number() OVER () AS k, page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, coalesce(url, '') AS text,
    ('0x' || substr(md5(coalesce(url, '')), 1, 8))::BIGINT % {HELD_OUT} = 0 AS held
  FROM pages
), v AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM u
), w AS (
  SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS by_rule FROM v
), gr AS (
  SELECT k, by_rule, substr(s, i, {ORDER + 1}) AS gram
  FROM (SELECT k, CASE WHEN NOT held THEN by_rule END AS by_rule, repeat(chr(2), {ORDER}) || text || chr(3) AS s, unnest(range(1, length(text) + 2)) AS i FROM w)
), full_grams AS (
  SELECT gram, count(*) FILTER (WHERE by_rule = 'allow') AS a, count(*) FILTER (WHERE by_rule = 'block') AS b FROM gr GROUP BY 1
),{",".join(_order_sql(k) for k in range(ORDER + 1))},
sc AS (
  SELECT k, round(avg(ln(pa) - ln(pb)), 9) AS score FROM gr JOIN p{ORDER} ON p{ORDER}.g = gr.gram GROUP BY k
), mean AS (
  SELECT by_rule, coalesce(avg(score) FILTER (WHERE held), avg(score)) AS m FROM sc JOIN w USING (k) WHERE by_rule IS NOT NULL GROUP BY by_rule
), m AS (
  SELECT CASE WHEN count(*) = 2 THEN round(sum(m) / 2, 9) ELSE 0 END AS bar FROM mean
)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN score >= bar THEN 'allow' ELSE 'block' END) AS verdict
FROM w JOIN sc USING (k), m
"""
