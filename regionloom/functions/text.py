"""Id, name and metadata text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed value: a timepoint label counts tenths of a day
TIMEPOINT_PATTERN = r"d(\d+)"


def motif_name(c: Column) -> Column:
    """Drop the group prefix ``HCLUST-12_`` and the suffix ``.UNK.0.A``."""
    return F.regexp_replace(F.regexp_replace(c, r"HCLUST-\d+_", ""), r"\.UNK\.0\.A", "")


def rule_id(example: Column) -> Column:
    """Rule part of an example id: the trailing ``.<number>`` is cut."""
    return F.regexp_replace(example, r"\.\d+$", "")


def joined_max(c: Column) -> Column:
    """Largest integer of a comma-joined list."""
    return F.array_max(F.transform(F.split(c, ","), lambda x: x.try_cast("int")))


def day_of(label: Column) -> Column:
    """``d05`` is day 0.5, ``d30`` day 3."""
    return F.regexp_extract(label, TIMEPOINT_PATTERN, 1).try_cast("double") / 10


def label_of(day: Column) -> Column:
    return F.concat(F.lit("d"), F.lpad(F.round(day * 10).cast("int").cast("string"), 2, "0"))


def metadata_field(c: Column, field: str) -> Column:
    """One value of ``k=v;k=v`` text."""
    return F.str_to_map(c, F.lit(";"), F.lit("=")).getItem(field)


def reporter_group(unique_id: Column) -> Column:
    """Reporter id without its barcode and combination parts."""
    return F.regexp_replace(F.regexp_replace(unique_id, r"\.barcode-[^.]*", ""), r"\.combo-[^.]*", "")


def unique_prefix(read_name: Column) -> Column:
    """Text before the first bar."""
    return F.regexp_replace(read_name, r"\|.*$", "")


def any_of(c: Column, words: list[str]) -> Column:
    """True where the text holds one of ``words`` (plain text, not patterns)."""
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(c, F.lit(w))
    return hit
