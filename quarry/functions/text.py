"""Text column functions: normal forms, section roles, claims, citation markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalise(text: Column) -> Column:
    """Lower case, ASCII punctuation to spaces, white space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", " "), r"[ \t\n\r\f]+", " "))


def section_role(header: Column) -> Column:
    """conclusion, method, result, background or other; the first that matches."""
    h = F.lower(header)
    return (
        F.when(h.rlike("conclusion|summary|discussion"), "conclusion").when(h.rlike("method|data|observation|experiment"), "method")
        .when(h.rlike("result|finding"), "result").when(h.rlike("introduction|background|related"), "background").otherwise("other")
    )


def negative_tier(text: Column) -> Column:
    """How plainly a text states a negative result: high, medium, low or null."""
    t = F.lower(text)
    return (
        F.when(t.rlike(r"\b(null result|no evidence (of|for)|failed to (detect|find|replicate))\b"), "high")
        .when(t.rlike(r"\b(not significant|no significant|did not (find|detect|observe))\b"), "medium")
        .when(t.rlike(r"\b(inconclusive|unlikely|could not)\b"), "low")
    )


def citation_markers(text: Column) -> Column:
    """Numbers cited as ``[1]`` or ``[1, 3-5]``, ranges expanded, in order."""
    groups = F.regexp_extract_all(text, F.lit(r"\[([0-9]+(?:[ ]*[,-][ ]*[0-9]+)*)\]"), 1)
    parts = F.flatten(F.transform(groups, lambda g: F.split(g, "[ ]*,[ ]*")))

    def expand(p: Column) -> Column:
        ends = F.transform(F.split(p, "[ ]*-[ ]*"), lambda x: x.cast("int"))
        lo, hi = F.element_at(ends, 1), F.element_at(ends, -1)
        return F.when(hi >= lo, F.sequence(lo, F.least(hi, lo + 1000))).otherwise(F.array(lo, hi))

    return F.flatten(F.transform(parts, expand))
