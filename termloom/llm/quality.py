"""Quality rules with thresholds that adapt to each language and source. Built-in functions only.

Each row's ratios are whole numbers (symbols, upper-case letters, repeated lines and repeated
words in thousandths; hundredths of the mean word length). A sketch of a ratio is a histogram on a
fixed grid of CELL wide cells: sketches of parts add up to the sketch of the whole, a quantile is
right to one cell, and the result doesn't depend on how rows were dealt out. Sketches are built
per language and source from the rows that pass the base rules; a group of under MIN_GROUP rows
takes its language's merged sketch, a small language the merged sketch of all. A row is rejected
where a ratio lies beyond a quantile of its group by a multiple of that quantile's distance from the
median; beside it there is one cell, the sketch's own error, and no constant. Where junk may make up
several percent of a group (symbols, word length), the quantile is one that junk doesn't reach.

Defined cases: null text is empty and fails the base rules; null language or source is a group of
its own; rows with null doc_id are rows like others; repeated rows and ties count each; extra
columns are ignored (and kept by the pipeline's stage).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import staged, table

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
MIN_GROUP, CELL = 100, 5
#: Ratio, quantile in percent, multiple of its distance from the median that the limit lies beyond it,
#: and whether there is a lower limit of the same kind.
RATIOS = {"r_symbols": (75, 5, False), "r_upper": (99, 1, False), "r_lines": (99, 1, False), "r_words": (99, 1, False), "r_length": (90, 5, True)}
QUANTILES = sorted({50, *(q for q, _, _ in RATIOS.values()), *(100 - q for q, _, two in RATIOS.values() if two)})
SPACES = r"[\x20\x09-\x0D]+"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(df: DataFrame) -> DataFrame:
    """n_repeat_words of the column _w: words inside windows found more than once."""
    last = F.size("_w") - WINDOW
    df = df.withColumn("_h", F.when(last >= 1, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice("_w", i + 1, WINDOW)))))
    # for most texts all windows differ, which is cheap to see
    some = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.withColumn("_s", F.when(some, F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    at = lambda k: F.col("_s")[k]["x"]
    n = F.size("_s")
    again = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda k: F.when(((k > 0) & (at(F.greatest(k - 1, F.lit(0))) == at(k))) | ((k < n - 1) & (at(F.least(k + 1, n - 1)) == at(k))), F.col("_s")[k]["i"]),
    )
    df = df.withColumn("_i", F.when(F.col("_s").isNotNull(), F.sort_array(F.filter(again, lambda x: x.isNotNull()))))
    covered = F.aggregate(
        "_i",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + i + WINDOW - F.greatest(a["end"], i)).cast("long").alias("n")),
        lambda a: a["n"],
    )
    return df.withColumn("n_repeat_words", F.when(F.col("_i").isNotNull(), covered).otherwise(F.lit(0)).cast("long")).drop("_h", "_s", "_i")


def measured(docs: DataFrame) -> DataFrame:
    """docs with the base columns, base_failed and the ratios."""
    df = docs.withColumn("_t", F.coalesce(F.col("text").cast("string"), F.lit("")))
    df = df.withColumn("_p", F.expr(r"trim(BOTH ' \t\n\u000B\f\r' FROM _t)".replace(r"\f", r"\u000C")))
    df = df.withColumn("_w", F.when(F.col("_p") == "", F.array().cast("array<string>")).otherwise(F.split("_p", SPACES)))
    df = _repeat_words(df)
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("_l", lines)
    df = df.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.regexp_replace("_t", SPACES, "")).cast("long"),
            "n_symbols": F.regexp_count("_t", F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "_lines": F.size("_l").cast("long"),
            "_upper": F.regexp_count("_t", F.lit("[A-ZÀ-ÖØ-Þ]")).cast("long"),
        }
    )
    df = df.withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"))
    ratios = {
        "r_symbols": "1000 * n_symbols div greatest(word_chars, 1)",
        "r_upper": "1000 * _upper div greatest(word_chars, 1)",
        "r_lines": "1000 * n_dup_lines div greatest(_lines, 1)",
        "r_words": "1000 * n_repeat_words div greatest(n_words, 1)",
        "r_length": "100 * word_chars div greatest(n_words, 1)",
    }
    return df.withColumns({k: F.expr(v) for k, v in ratios.items()}).drop("_t", "_p", "_w", "_l", "_lines", "_upper")


def _quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """QUANTILES (lower ends of their cells) of sketches given as (keys, ratio, cell, n)."""
    by = W.partitionBy(*keys, "ratio")
    s = sketch.withColumn("up_to", F.sum("n").over(by.orderBy("cell").rowsBetween(W.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(by))
    q = {f"q{p}": F.min(F.when(100 * F.col("up_to") >= p * F.col("all"), F.col("cell"))) * CELL for p in QUANTILES}
    return s.groupBy(*keys, "ratio").agg(*(v.alias(k) for k, v in q.items()))


def _limits(name: str) -> dict[str, str]:
    """Limits of a ratio as expressions over its quantiles, for Spark and SQL."""
    q, times, two = RATIOS[name]
    out = {f"hi_{name}": f"q{q} + {times} * (q{q} - q50) + {CELL}"}
    return out | ({f"lo_{name}": f"q{100 - q} - {times} * (q50 - q{100 - q}) - {CELL}"} if two else {})


def thresholds(rows: DataFrame) -> DataFrame:
    """(lang, source, lo_<ratio>, hi_<ratio>): limits of each language and source."""
    good = rows.where(~F.col("base_failed"))
    cells = F.explode(F.array(*(F.struct(F.lit(r).alias("ratio"), F.expr(f"{r} div {CELL}").alias("cell")) for r in RATIOS))).alias("x")
    fine = staged(good.select("lang", "source", cells).groupBy("lang", "source", "x.ratio", "x.cell").agg(F.count("*").alias("n")), "sketches")
    by_lang = fine.groupBy("lang", "ratio", "cell").agg(F.sum("n").alias("n"))
    by_all = fine.groupBy("ratio", "cell").agg(F.sum("n").alias("n"))
    one = F.col("ratio") == next(iter(RATIOS))
    n_group = fine.where(one).groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    n_lang = fine.where(one).groupBy("lang").agg(F.sum("n").alias("n_lang"))
    groups = rows.select("lang", "source").distinct()
    groups = _null_safe(groups, n_group, ["lang", "source"])
    groups = _null_safe(groups, n_lang, ["lang"])
    enough = lambda c: F.coalesce(F.col(c), F.lit(0)) >= MIN_GROUP
    own = _null_safe(groups.where(enough("n_group")), _quantiles(fine, ["lang", "source"]), ["lang", "source"])
    lang = _null_safe(groups.where(~enough("n_group") & enough("n_lang")), _quantiles(by_lang, ["lang"]), ["lang"])
    rest = groups.where(~enough("n_group") & ~enough("n_lang")).withColumn("ratio", F.explode(F.array(*map(F.lit, RATIOS))))
    rest = rest.join(_quantiles(by_all, []), "ratio", "left")
    every = own.unionByName(lang).unionByName(rest)
    limits = [F.max(F.when(F.col("ratio") == r, F.expr(e))).alias(name) for r in RATIOS for name, e in _limits(r).items()]
    return every.groupBy("lang", "source").agg(*limits)


def _null_safe(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that takes null keys as equal."""
    b = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return a.join(b, on, "left").drop(*(f"_{k}" for k in keys))


def _within() -> str:
    """Whether all ratios keep to their limits, for Spark and SQL; without a limit any value does."""
    return " and ".join(f"coalesce({r} {'<=' if name[:2] == 'hi' else '>='} {name}, true)" for r in RATIOS for name in _limits(r))


def judged(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep of every row of docs(text, lang, source), the base columns, base_failed and kept."""
    rows = staged(measured(docs).select(*dict.fromkeys([*keep, "lang", "source", *BASE, "base_failed", *RATIOS])), "measured")
    out = _null_safe(rows, thresholds(rows), ["lang", "source"])
    return out.select(*keep, *BASE, "base_failed", F.expr(f"not base_failed and {_within()}").alias("kept"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), ["doc_id"])


OP8_SQL = rf"""
with d as (
  select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as t from documents
), w as (
  select r, doc_id, lang, source, t,
    list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from d
), win as (
  select r, i, array_to_string(list_slice(w, i, i + {WINDOW - 1}), ' ') as x
  from (select r, w, unnest(range(1, greatest(1, len(w) - {WINDOW} + 2))) as i from w where len(w) >= {WINDOW})
), again as (
  select r, i from (select r, i, count(*) over (partition by r, x) as c from win) where c > 1
), rep as (
  select r, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) as n from (select r, i, lead(i) over (partition by r order by i) as nxt from again) group by r
), m as (
  select w.r, doc_id, lang, source, cast(len(w) as bigint) as n_words,
    cast(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, cast(len(l) as bigint) as n_lines,
    cast(coalesce(rep.n, 0) as bigint) as n_repeat_words,
    cast(length(t) - length(regexp_replace(t, '[A-ZÀ-ÖØ-Þ]', '', 'g')) as bigint) as n_upper
  from w left join rep on rep.r = w.r
), x as (
  select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed,
    1000 * n_symbols // greatest(word_chars, 1) as r_symbols, 1000 * n_upper // greatest(word_chars, 1) as r_upper,
    1000 * n_dup_lines // greatest(n_lines, 1) as r_lines, 1000 * n_repeat_words // greatest(n_words, 1) as r_words,
    100 * word_chars // greatest(n_words, 1) as r_length
  from m
), long as (
  unpivot (select lang, source, {", ".join(RATIOS)} from x where not base_failed) on {", ".join(RATIOS)} into name ratio value v
), sizes as (
  select lang, source, count(*) as n, sum(count(*)) over (partition by lang) as n_lang from x where not base_failed group by lang, source
), g as (
  select distinct x.lang, x.source, case when coalesce(s.n, 0) >= {MIN_GROUP} then 0 when coalesce(l.n_lang, 0) >= {MIN_GROUP} then 1 else 2 end as lev
  from x left join sizes s on s.lang is not distinct from x.lang and s.source is not distinct from x.source
    left join (select distinct lang, n_lang from sizes) l on l.lang is not distinct from x.lang
), h as (
  select g.lang, g.source, ratio, v // {CELL} as cell, count(*) as n
  from g join long on (lev > 1 or g.lang is not distinct from long.lang) and (lev > 0 or g.source is not distinct from long.source)
  group by all
), c as (
  select *, sum(n) over (partition by lang, source, ratio order by cell) as up_to, sum(n) over (partition by lang, source, ratio) as total from h
), q as (
  select lang, source, ratio, {", ".join(f"{CELL} * min(cell) filter (100 * up_to >= {p} * total) as q{p}" for p in QUANTILES)} from c group by all
), lim as (
  select lang, source, {", ".join(f"max({e}) filter (ratio = '{r}') as {name}" for r in RATIOS for name, e in _limits(r).items())} from q group by all
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {_within()} as kept
from x left join lim on lim.lang is not distinct from x.lang and lim.source is not distinct from x.source
"""
