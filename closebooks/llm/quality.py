"""Quality rules with thresholds that follow the data.

Measures of a document (shares of symbols, of repeated lines, of repeated words; length of
words) are gathered into quantile sketches, one for each language and source: counts of
values in bins of 1/32 relative width. Sketches merge by adding counts. Every source is judged
by its own sketch with PRIOR documents of its language's and PRIOR of the whole table's added
in proportion, so that a small source follows its language and a large one itself, without a
size at which that changes. A document is rejected when a measure lies beyond a high (or low)
quantile by more than so many times that quantile's distance from the median (which counts as
STEP at least, the width of a bin in mid-scale). Documents that fail the base rules stay out of
the sketches.

Built-in functions only. Defined cases: a null text has no words and fails the base rules;
null languages and sources are groups of their own; repeated rows count each; an empty
table gives an empty result; other columns are ignored or, by `passed`, returned unchanged.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from closebooks.llm.common import SPACE, WORD, stored

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
PRIOR = 100  # documents of the language, and of the whole table, that a sketch starts with
STEP = 8
#: Measures: low and high quantile in per cent, and the distances allowed beyond them.
#: Clean texts repeat words and lines now and then, hence the far quantile with few distances;
#: symbols and word lengths part junk from text, hence the near one with more.
RULES = {"symbol_share": (None, 90, 5), "dup_line_share": (None, 99, 2),
         "repeat_share": (None, 99, 2), "word_length": (10, 90, 5)}


def _bind(value: Column, use) -> Column:
    """use(value) with the value computed once: the one element of an array."""
    return F.transform(F.array(value), use)[0]


def _repeated(words: Column) -> Column:
    """Words in windows of three that the text holds twice or more.

    Windows are sorted by hash; a repeated one has an equal neighbour. The repeated windows
    in order of place then cover min(3, distance to the one before) new words each.
    """
    windows = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1),
                                      F.get(words, i + 2)).alias("h"), i.alias("i")))
    twice = _bind(F.sort_array(windows), lambda s: F.filter(
        s, lambda x, j: F.coalesce(x["h"] == F.get(s, j - 1)["h"], F.lit(False))
        | F.coalesce(x["h"] == F.get(s, j + 1)["h"], F.lit(False))))
    covered = F.aggregate(
        F.sort_array(F.transform(twice, lambda x: x["i"])),
        F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"),
                              i.alias("last")),
        lambda a: a["n"])
    return F.when(F.size(words) < 3, 0).otherwise(covered)


def measured(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Column `row` with the carried columns, language, source, base figures and measures."""
    text = F.coalesce(F.col("text"), F.lit(""))
    of_words = _bind(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(
        F.size(w).alias("n_words"), _repeated(w).alias("n_repeat_words")))
    of_lines = _bind(
        F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0),
        lambda x: F.struct(F.size(x).alias("n_lines"),
                           (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))

    def share(part: str, whole: str, unit: int) -> Column:
        return F.floor(F.lit(unit) * F.col(part) / F.greatest(F.col(whole), F.lit(1)))

    count = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    return (
        docs.select(
            F.struct(*carry).alias("row"), "lang", "source",
            of_words.alias("w"), of_lines.alias("l"),
            F.length(F.translate(text, SPACE, "")).alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"))
        .select("row", "lang", "source", "w.*", "l.*", "word_chars", "n_symbols")
        .select("row", "lang", "source", *(F.col(c).cast("long").alias(c) for c in count))
        .withColumns({
            "symbol_share": share("n_symbols", "word_chars", 1000),
            "dup_line_share": share("n_dup_lines", "n_lines", 1000),
            "repeat_share": share("n_repeat_words", "n_words", 1000),
            "word_length": share("word_chars", "n_words", 100),
            "base_failed": (F.col("n_words") < LEAST_WORDS)
            | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        })
    )


def sketches(rows: DataFrame) -> DataFrame:
    """Counts by language, source, measure and bin (its lower end)."""
    values = F.explode(F.array(*(
        F.struct(F.lit(m).alias("measure"), F.col(m).cast("long").alias("v")) for m in RULES)))
    cut = F.greatest(F.length(F.bin("x.v")) - 6, F.lit(0))
    low = F.expr("shiftleft(shiftright(x.v, cut), cut)")
    return (
        rows.where(~F.col("base_failed")).select("lang", "source", values.alias("x"))
        .withColumn("cut", cut)
        .groupBy("lang", "source", "x.measure", low.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    return reduce(Column.__and__, (a[c].eqNullSafe(b[f"r_{c}"]) for c in names))


def _with_counts(rows: DataFrame, counts: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Column n of `counts` by keys that may be null; 0 where there is none."""
    right = counts.select(*(F.col(c).alias(f"r_{c}") for c in keys), F.col(n).alias("r_n"))
    joined = rows.join(right, _same(rows, right, keys), "left")
    return joined.select(*rows.columns, F.coalesce("r_n", F.lit(0)).alias(n))


def blended(sketch: DataFrame) -> DataFrame:
    """(lang, source, measure, bin, weight): every source's sketch with its prior.

    Weights are whole numbers: counts times the rows of the language times those of all.
    A source has as many rows as the measure has bins, some hundreds at most.
    """
    bins = sketch.groupBy("measure", "bin").agg(F.sum("n").alias("n_all"))
    every = sketch.groupBy("measure").agg(F.sum("n").alias("rows_all"))
    langs = sketch.groupBy("lang", "measure").agg(F.sum("n").alias("rows_lang"))
    prior = _with_counts(
        langs.join(bins, "measure").join(every, "measure"),
        sketch.groupBy("lang", "measure", "bin").agg(F.sum("n").alias("n_lang")),
        ["lang", "measure", "bin"], "n_lang")
    groups = sketch.select("lang", "source", "measure").distinct()
    right = prior.select(F.col("lang").alias("r_lang"), F.col("measure").alias("r_measure"),
                         "bin", "n_all", "rows_all", "n_lang", "rows_lang")
    rows = groups.join(right, _same(groups, right, ["lang", "measure"])).drop(
        "r_lang", "r_measure")
    rows = _with_counts(rows, sketch, ["lang", "source", "measure", "bin"], "n")
    n, n_lang, n_all, of_lang, of_all = (F.col(c).cast("decimal(38,0)") for c in (
        "n", "n_lang", "n_all", "rows_lang", "rows_all"))
    weight = n * of_lang * of_all + PRIOR * (n_lang * of_all + n_all * of_lang)
    return rows.select("lang", "source", "measure", "bin",
                       weight.cast("decimal(38,0)").alias("weight"))


def thresholds(rows: DataFrame) -> DataFrame:
    """One row per language and source: thresholds of every measure."""
    sketch = stored(sketches(rows), "quality-sketch")
    group = Window.partitionBy("lang", "source", "measure")
    placed = blended(sketch).select(
        "lang", "source", "measure", "bin", F.sum("weight").over(group.orderBy("bin")).alias("below"),
        F.sum("weight").over(group).alias("total"))

    def quantile(measure: str, percent: int) -> Column:
        reached = F.lit(100) * F.col("below") >= F.lit(percent) * F.col("total")
        return F.min(F.when((F.col("measure") == measure) & reached, F.col("bin")))

    columns = []
    for m, (low, high, times) in RULES.items():
        middle, top = quantile(m, 50), quantile(m, high)
        columns.append((top + times * F.greatest(top - middle, F.lit(STEP))).alias(f"{m}_hi"))
        if low is not None:
            end = quantile(m, low)
            columns.append((end - times * F.greatest(middle - end, F.lit(STEP))).alias(f"{m}_lo"))
    return placed.groupBy(
        F.col("lang").alias("of_lang"), F.col("source").alias("of_source")).agg(*columns)


def _inside(measure: str) -> Column:
    ok = F.col(measure) <= F.col(f"{measure}_hi")
    return ok if RULES[measure][0] is None else ok & (F.col(measure) >= F.col(f"{measure}_lo"))


def judged(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The measured rows with the verdict `kept`."""
    rows = stored(measured(docs, carry), "quality-measures")
    limits = stored(thresholds(rows), "quality-thresholds")
    inside = reduce(Column.__and__, map(_inside, RULES))
    # A group of which every document failed has no thresholds, and none to keep.
    return rows.join(
        limits, rows["lang"].eqNullSafe(limits["of_lang"])
        & rows["source"].eqNullSafe(limits["of_source"]), "left",
    ).withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False)))


def verdicts(docs: DataFrame) -> DataFrame:
    """Per document: its base figures and whether it is kept."""
    return judged(docs, ["doc_id"]).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def passed(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns."""
    return judged(docs, docs.columns).where("kept").select("row.*")


_MEASURES_SQL = ", ".join(f"('{m}', {m})" for m in RULES)


def _quantile_sql(measure: str, percent: int) -> str:
    return f"min(bin) filter (measure = '{measure}' and 100 * below >= {percent} * total)"


def _limits_sql() -> str:
    out = []
    for m, (low, high, times) in RULES.items():
        middle, top = _quantile_sql(m, 50), _quantile_sql(m, high)
        out.append(f"{top} + {times} * greatest({top} - {middle}, {STEP}) as {m}_hi")
        if low is not None:
            end = _quantile_sql(m, low)
            out.append(f"{end} - {times} * greatest({middle} - {end}, {STEP}) as {m}_lo")
    return ",\n    ".join(out)


def _inside_sql(m: str) -> str:
    return f"{m} <= {m}_hi" + (f" and {m} >= {m}_lo" if RULES[m][0] is not None else "")


VERDICTS_SQL = f"""
with docs as (
  select doc_id, lang, source, coalesce(text, '') as t from documents),
cut as (
  select *, row_number() over () as rid,
    regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l
  from docs),
windows as (
  select rid, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] as g
  from (select rid, w, unnest(range(1, len(w) - 1)) as i from cut)),
twice as (
  select rid, i from (select rid, i, count(*) over (partition by rid, g) as n from windows)
  where n > 1),
covered as (
  select rid, sum(least(3, i - coalesce(before, -9))) as n_repeat_words
  from (select rid, i, lag(i) over (partition by rid order by i) as before from twice)
  group by rid),
base as (
  select doc_id, lang, source, len(w) as n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    len(l) - len(list_distinct(l)) as n_dup_lines, len(l) as n_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from cut left join covered using (rid)),
rows_ as (
  select *, 1000 * n_symbols // greatest(word_chars, 1) as symbol_share,
    1000 * n_dup_lines // greatest(n_lines, 1) as dup_line_share,
    1000 * n_repeat_words // greatest(n_words, 1) as repeat_share,
    100 * word_chars // greatest(n_words, 1) as word_length,
    n_words < {LEAST_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed
  from base),
sketch as (
  select lang, source, measure, (v >> cut) << cut as bin, count(*) as n
  from (select lang, source, measure, v, greatest(length(bin(v)) - 6, 0) as cut
        from rows_, lateral (select * from (values {_MEASURES_SQL}) x(measure, v))
        where not base_failed)
  group by all),
bins as (select measure, bin, sum(n)::hugeint as n_all from sketch group by all),
every as (select measure, sum(n)::hugeint as rows_all from sketch group by all),
langs as (select lang, measure, sum(n)::hugeint as rows_lang from sketch group by all),
of_lang as (select lang, measure, bin, sum(n)::hugeint as n_lang from sketch group by all),
groups_ as (select distinct lang, source, measure from sketch),
blended as (
  select g.lang, g.source, g.measure, b.bin,
    coalesce(s.n, 0)::hugeint * l.rows_lang * e.rows_all
      + {PRIOR} * (coalesce(o.n_lang, 0) * e.rows_all + b.n_all * l.rows_lang) as weight
  from groups_ g
    join langs l on g.lang is not distinct from l.lang and g.measure = l.measure
    join bins b on g.measure = b.measure join every e on g.measure = e.measure
    left join of_lang o on g.lang is not distinct from o.lang and g.measure = o.measure
      and b.bin = o.bin
    left join sketch s on g.lang is not distinct from s.lang
      and g.source is not distinct from s.source and g.measure = s.measure and b.bin = s.bin),
placed as (
  select *, sum(weight) over (partition by lang, source, measure order by bin)::hugeint as below,
    sum(weight) over (partition by lang, source, measure)::hugeint as total
  from blended),
wide as (
  select lang, source, {_limits_sql()}
  from placed group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and coalesce({" and ".join(map(_inside_sql, RULES))}, false) as kept
from rows_ r left join wide w
  on r.lang is not distinct from w.lang and r.source is not distinct from w.source
"""
