"""Text expressions: tokens, citations, grounding and masking (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a citation.
BRACKET_REF = r"\[[A-Za-z-]+ [0-9][^\]]*\]"
CLAUSE_REF = r"(Section|Rule|Regulation|Clause|Article) [0-9]+[A-Z-]*"
LOOKUP_PREFIX = "[MANUAL POLICY LOOKUP REQUIRED: "


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def normalised(ref: Column) -> Column:
    """A reference without brackets and without sub-items such as (a)."""
    return F.trim(F.regexp_replace(ref, r"\[|\]|\([a-z0-9]+\)", ""))


def ungrounded(narrative: Column, cited: Column, allowed: Column, context: Column) -> Column:
    """References of a narrative that no allowed section or context supports.

    A reference is grounded when an allowed section label starts with it or the
    context contains it. Missing inputs count as empty, so the check fails closed.
    Everything happens inside one row: no explode, no join, no shuffle.
    """
    none = F.array().cast("array<string>")
    text = F.coalesce(narrative, F.lit(""))
    labels = F.coalesce(allowed, none)
    ctx = F.coalesce(context, F.lit(""))
    bracketed = F.concat(F.coalesce(cited, none), F.regexp_extract_all(text, F.lit(BRACKET_REF), F.lit(0)))
    clauses = F.regexp_extract_all(text, F.lit(CLAUSE_REF), F.lit(0))

    def open_ref(norm: Column) -> Column:
        return ~F.exists(labels, lambda a: F.startswith(a, norm)) & ~F.contains(ctx, norm)

    bad = F.concat(F.filter(bracketed, lambda r: open_ref(normalised(r))), F.filter(clauses, open_ref))
    return F.array_sort(F.array_distinct(bad))


def longest_first(refs: Column) -> Column:
    keyed = F.array_sort(F.transform(refs, lambda r: F.struct((-F.length(r)).alias("l"), r.alias("r"))))
    return F.transform(keyed, lambda s: s["r"])


def masked(narrative: Column, refs: Column) -> Column:
    """Replace every given reference by a request for manual lookup."""

    def replace_one(text: Column, ref: Column) -> Column:
        bare = F.replace(F.replace(ref, F.lit("["), F.lit("")), F.lit("]"), F.lit(""))
        return F.replace(text, ref, F.concat(F.lit(LOOKUP_PREFIX), bare, F.lit("]")))

    return F.aggregate(longest_first(refs), narrative, replace_one)
