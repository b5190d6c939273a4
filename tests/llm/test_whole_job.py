"""Corpus operators do the whole of their job, not a part that is easy to compare."""

import hashlib
import math
from collections import Counter

DATA = "/root/testdata/sf0.001"


# ------------------------------------------------------------- 10: URL filter


def plain_verdicts(urls, by_rule):
    """Scores and verdicts of whole URLs, by counting; a fifth calibrates and does not train."""
    from quillspark.llm.urls import END, ORDER, PRIOR, START

    padded = [START * ORDER + (u or "") + END for u in urls]
    rows = [[t[k : k + ORDER + 1] for k in range(len(t) - ORDER)] for t in padded]
    held = [int(hashlib.md5((u or "").encode()).hexdigest()[:8], 16) % 5 == 0 for u in urls]
    count = {v: Counter(g for gs, r, h in zip(rows, by_rule, held, strict=True) if r == v and not h for g in gs) for v in ("allow", "block")}
    every = sorted({g for gs in rows for g in gs})
    prob = {}
    for v in count:
        below = None
        for k in range(ORDER + 1):
            own, ctx, kinds = Counter(), Counter(), Counter()
            for g in {g[ORDER - k :] for g in every}:
                kinds[g[:k]] += 1
            for g, n in count[v].items():
                own[g[ORDER - k :]] += n
                ctx[g[ORDER - k : ORDER]] += n
            below = {g: (own[g] + PRIOR * (1 / kinds[g[:k]] if below is None else below[g[1:]])) / (ctx[g[:k]] + PRIOR) for g in {g[ORDER - k :] for g in every}}
        prob[v] = below
    score = [round(sum(math.log(prob["allow"][g]) - math.log(prob["block"][g]) for g in gs) / len(gs), 9) for gs in rows]
    mean = {v: [s for s, r, h in zip(score, by_rule, held, strict=True) if r == v and h] or [s for s, r in zip(score, by_rule, strict=True) if r == v] for v in count}
    bar = round(sum(sum(x) / len(x) for x in mean.values()) / 2, 9) if all(mean.values()) else 0
    return score, [r or ("allow" if s >= bar else "block") for s, r in zip(score, by_rule, strict=True)]


def test_url_model_reads_whole_urls(spark):
    from quillspark.llm.urls import judge

    urls = [f"http://a{k}.com/page?good=alpha{k}" for k in range(40)] + [f"http://b{k}.net/es/page?bad=omega{k}#zzz" for k in range(40)]
    urls += ["http://c.org/page?good=alpha7", "http://c.org/page?bad=omega7#zzz", "good=alpha8", "bad=omega8#zzz", "", None]
    rows = sorted(judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect())
    by_rule = ["allow"] * 40 + ["block"] * 40 + [None] * 6
    score, verdict = plain_verdicts(urls, by_rule)
    assert [r.verdict for r in rows] == verdict
    assert all(abs(r.score - s) < 1e-7 for r, s in zip(rows, score, strict=True))
    # alike but for the query; without a scheme
    assert verdict[80:84] == ["allow", "block", "allow", "block"]


def test_url_query_reads_whole_urls(spark):
    from quillspark.llm.urls import op10_url_filter

    urls = {r.page_id: r.url for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = {r.page_id: r for r in op10_url_filter(spark, DATA).collect()}
    by_rule = [got[k].verdict if got[k].rule else None for k in urls]
    assert [got[k].verdict for k in urls] == plain_verdicts(list(urls.values()), by_rule)[1]


# -------------------------------------------------------- 4: personal data


def discovered(spark, rows):
    from quillspark.llm.pii import find

    return {r.doc_id: len(r.spans) for r in find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_more_to_discover_than_seeds(spark):
    """100 seeds and 150 candidates of one context: all are found."""
    rows = [(k, f"please call me at +1 (555) 555-{1000 + k} thanks") for k in range(100)]
    rows += [(1000 + k, f"please call me at 555-867-{1000 + k} thanks") for k in range(150)] + [(2000, "order number 555-867-9999 shipped")]
    got = discovered(spark, rows)
    assert sum(got[1000 + k] for k in range(150)) == 150 and not got[2000]


def test_discovered_instances_prove_patterns(spark):
    """A context without any seed is proven by instances that another one has proven."""
    rows = [(k, f"please call me at +1 (555) 555-{1000 + k} thanks") for k in range(5)]
    rows += [(100 + k, f"please call me at 555-867-{1000 + k} thanks") for k in range(5)]
    rows += [(200 + k, f"just ring this extension 555-867-{1000 + k} today") for k in range(5)]
    rows += [(300, "just ring this extension 555-867-7777 today"), (301, "order number 555-867-8888 shipped")]
    got = discovered(spark, rows)
    assert got[300] == 1 and got[301] == 0


def test_counter_examples_disprove(spark):
    """Dates and times speak against a context, and are never found themselves."""
    rows = [(k, f"we met them on +1 (555) 555-{1000 + k} thanks") for k in range(4)]
    rows += [(100 + k, f"we met them on 2021-03-{10 + k} thanks") for k in range(9)] + [(200, "we met them on 555-867-5309 thanks")]
    got = discovered(spark, rows)
    assert not any(got[100 + k] for k in range(9)) and not got[200]


# -------------------------------------------------------------- 6: secrets


def test_every_candidate_has_a_class():
    import itertools
    import re

    from quillspark.llm.secrets import CLASSES  # name, patterns that all must match, bits

    for parts in itertools.chain.from_iterable(itertools.permutations(["a", "Z", "7", "-", "b", "0"], n) for n in range(1, 7)):
        assert any(all(re.search(p, "".join(parts) * 20) for p in ps) for _, ps, _ in CLASSES), parts


def test_secrets_of_all_alphabets(spark):
    """Separators beside one case and digits, letters alone: found by entropy; words are not."""
    from quillspark.llm.secrets import scan

    yes = ["tok_9f8g7h6j5k4l3m2n1p0qzrwxyvut", "TOK-9F8G7H6J5K4L3M2N1P0QZRWXYVUT", "qWmZxKvBnTyHgRfDpLsJcUeAoI/+VbNk", "zqxwvjkpygbmfhcdutlsrnoeia"]
    no = ["keitstlichschenverpf", "Einungtzheitgeungverlich", "internationalization-of-words", "see_chapter_2_of_the_first_book", "-" * 40, "lib/site-packages/package/module"]
    rows = list(enumerate(yes + no))
    got = {r.doc_id: [s.value for s in r.found] for r in scan(spark.createDataFrame([(k, f"here {v} ends") for k, v in rows], "doc_id long, text string")).collect()}
    assert [got[k] for k, _ in rows] == [[v] for v in yes] + [[]] * len(no)
