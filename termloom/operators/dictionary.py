"""A Chinese-English dictionary from its line format, and look-ups in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import pinyin, pinyin_syllable

#: Fixed value: traditional, simplified, [pinyin], /definition/.../
LINE = r"^(\S+)\s+\S+\s+\[([^\]]+)\]\s+/(.+)/$"
ALSO = "also pr. "


def parsed(lines: DataFrame) -> DataFrame:
    """(headword, pinyin_raw, definitions, alt_raw, line_no) of lines(line_no, value); comments and
    other lines are left out. The last "also pr." definition becomes the alternative pronunciation."""
    m = lines.where(~F.col("value").startswith("#") & F.col("value").rlike(LINE))
    m = m.select("line_no", *(F.regexp_extract("value", LINE, k).alias(c) for k, c in ((1, "headword"), (2, "pinyin_raw"), (3, "raw"))))
    m = m.withColumn("defs", F.filter(F.split("raw", "/"), lambda d: (d != "") & ~d.startswith("CL:")))
    last = F.array_max(F.filter(F.transform("defs", lambda d, i: F.when(d.startswith(ALSO), i)), lambda i: i.isNotNull()))
    m = m.withColumn("last", F.coalesce(last, F.lit(-1)))
    alt = F.regexp_extract(F.get("defs", F.greatest("last", F.lit(0))), r"^also pr\. \[(.*)\]$", 1)
    return m.select(
        "headword", "pinyin_raw", F.filter("defs", lambda d, i: i != F.col("last")).alias("definitions"),
        F.when(F.col("last") >= 0, F.filter(F.split(alt, " "), lambda x: x != "")).alias("alt_raw"), "line_no",
    )


def deduplicated(entries: DataFrame) -> DataFrame:
    """One entry a headword: the last with lower-case pinyin, else the first."""
    common = ~F.col("pinyin_raw").rlike("^[A-Z]")
    best = F.max_by(F.struct("pinyin_raw", "definitions", "alt_raw"), F.struct(common, F.when(common, F.col("line_no")).otherwise(-F.col("line_no"))))
    return entries.groupBy("headword").agg(best.alias("e")).select("headword", "e.*")


def dictionary(lines: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(headword, pinyin, definitions, alt_pronunciation) for targets(id), or for all headwords.
    Lines of other headwords go before their definitions are taken apart."""
    if targets is not None:
        head = F.regexp_extract("value", r"^(\S+)", 1)
        lines = lines.join(targets.select(F.col("id").alias("_id")).distinct(), head == F.col("_id"), "left_semi")
    e = deduplicated(parsed(lines))
    alt = F.when(F.size("alt_raw") > 0, F.transform("alt_raw", pinyin_syllable))
    return e.select("headword", pinyin(F.col("pinyin_raw")).alias("pinyin"), "definitions", alt.alias("alt_pronunciation"))


def looked_up(nodes: DataFrame, entries: DataFrame, shown: int = 7) -> DataFrame:
    """nodes(id) with what a tooltip shows: the first definitions, and whether there are more."""
    return nodes.join(entries, nodes.id == entries.headword, "left").select(
        *nodes.columns, "pinyin", F.slice("definitions", 1, shown).alias("definitions"), (F.size("definitions") > shown).alias("more"), F.array_join("alt_pronunciation", ", ").alias("also"),
    )
