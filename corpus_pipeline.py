"""The corpus pipeline: quality rules, line dedup, MinHash near-dedup, benchmark decontamination, best-fit packing."""

from __future__ import annotations

from glyphmill.llm import decontaminate, lines, neardup, packing, quality
from glyphmill.llm.common import settle, table


def quality_rules(spark, docs, sf_dir):
    return quality.reject(docs)


def line_dedup(spark, docs, sf_dir):
    return lines.dedup(docs)


def near_dedup(spark, docs, sf_dir):
    return neardup.keep_one(docs)


def decontamination(spark, docs, sf_dir):
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark, docs, sf_dir):
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]
#: Stages by estimates, sketches and tokenizers are not expressible in SQL; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The last stage's rows; each stage's documents are written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
