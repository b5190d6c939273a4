"""User-defined regex replacements, by line or by region of a document."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.kernels import java_template
from quillspark.operators.classify import regions, replacement_regions
from quillspark.operators.lines import doc_lines


@dataclass(frozen=True)
class Replacement:
    name: str
    pattern: str
    replacement: str
    timing: str = "after"
    in_code_blocks: bool = False
    in_frontmatter: bool = False

    @property
    def multi_line(self) -> bool:
        return any(x in self.pattern for x in (r"\n", r"[\s\S]", "(?s", "(?m"))

    @property
    def java(self) -> tuple[str, str]:
        """Pattern and template for Java: Unicode classes, ``.`` stops at LF only."""
        names = [m[1] for m in re.finditer(r"\(\?P?<([A-Za-z]\w*)>", self.pattern)]
        pattern = "(?Ud)" + re.sub(r"\(\?P<", "(?<", self.pattern)
        plain = len(re.findall(r"(?<!\\)\((?!\?)", self.pattern)) + len(names)
        known = {str(k): k for k in range(plain + 1)} | {n: n for n in names}
        return pattern, java_template(self.replacement, known)


def by_line(c: Column, rules: list[Replacement], in_code: Column, in_fm: Column) -> Column:
    """Every one-line "after" rule in order, where its region allows it."""
    for r in rules:
        if r.timing == "after" and not r.multi_line:
            ok = (F.lit(r.in_code_blocks) | ~in_code) & (F.lit(r.in_frontmatter) | ~in_fm)
            pattern, template = r.java
            c = F.when(ok, F.regexp_replace(c, pattern, template)).otherwise(c)
    return c


def by_document(docs: DataFrame, rules: list[Replacement], timing: str) -> DataFrame:
    """``(doc_id, text)``: "before" rules, or multi-line "after" rules, a region at a time.

    Regions are found anew for each rule, since a rule may change them.  A text that a rule empties
    stays as an empty line.
    """
    for r in rules:
        if r.timing != timing or (timing == "after" and not r.multi_line):
            continue
        pattern, template = r.java
        lines = replacement_regions(regions(doc_lines(docs)))
        segment = lines.groupBy("doc_id", "segment").agg(F.first("region").alias("region"), F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "l"))), lambda x: x["l"]), "\n"), F.lit("\n")).alias("t"))
        ok = F.col("region") == "text"
        ok = ok | (F.lit(r.in_code_blocks) & (F.col("region") == "code")) | (F.lit(r.in_frontmatter) & (F.col("region") == "front"))
        changed = segment.withColumn("t", F.when(ok, F.regexp_replace("t", pattern, template)).otherwise(F.col("t")))
        docs = changed.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("segment", "t"))), lambda x: x["t"]), "").alias("text"))
    return docs
