"""Quality rules with thresholds that adapt to each language and source, in DataFrame operations only.

Each document gets counts from its words and lines. Four rates derived from them are summarised by KLL quantile sketches
for each (language, source). Sketches merge, so a pair with few documents takes the thresholds of its language, and a
language with few those of all documents, without another look at the data. A rate is out of bounds if it lies more
than ``reach`` interquartile ranges beyond the quartiles. Most documents have no symbols or repeats at all, so for the
rates of those the bound is the group's ``upper`` quantile where that is higher, and ``events`` more symbols, lines or
repeated windows in a document of the group's median size. The thresholds are joined back to the documents.

Defined results: a null text has no words; null languages and sources form groups of their own; a document without
words fails the base rules; only documents that pass the base rules enter the sketches; repeated rows count each; a text is worked on whole, in memory that
grows with it; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rules:
    least_words: int = 20
    most_repeated: int = 30  # percent of words
    window: int = 8
    reach: float = 6.0
    least_rows: int = 100  # of a group that has thresholds of its own
    accuracy: int = 400  # k of the sketches
    upper: float = 0.9  # quantile; a group may hold as much junk beyond it
    events: int = 3
    #: Rates and the least interquartile range that is assumed for each.
    rates: dict[str, float] = field(default_factory=lambda: {"word_length": 0.5, "symbol_rate": 0.0, "dup_line_rate": 0.0, "repeat_rate": 0.0})
    #: What a rate is a part of.
    units: dict[str, str] = field(default_factory=lambda: {"symbol_rate": "n_words", "dup_line_rate": "n_lines", "repeat_rate": "n_words"})
    two_sided: tuple[str, ...] = ("word_length",)


def _keep(df: DataFrame, *columns: str, **new: Column) -> DataFrame:
    """Columns and new ones that are computed once: what follows a generator is never merged into what is before it."""
    fields = [c.alias(n) for n, c in new.items()]
    return df.select(*columns, F.inline(F.array(F.struct(*fields))))


def features(docs: DataFrame, rules: Rules = Rules(), id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """id, language, source, ``n_words``, ``word_chars``, ``n_symbols``, ``n_lines``, ``n_dup_lines``, ``n_repeat_words``."""
    x, own = F.col("_text"), ("_id", "_lang", "_source")
    df = docs.select(F.col(id).alias("_id"), F.col(lang).alias("_lang"), F.col(source).alias("_source"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    df = _keep(
        df, *own,
        words=F.transform(F.regexp_extract_all(x, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)),
        lines=F.filter(F.split(x, "\n"), lambda line: line.rlike(WORD)),
        word_chars=F.length(F.translate(x, " \t\n\x0b\x0c\r", "")).cast("long"),
        n_symbols=(F.length(x) - F.length(F.translate(x, SYMBOLS, ""))).cast("long"),
    )
    n, w = F.size("words"), rules.window
    none = F.array().cast("array<bigint>")
    df = _keep(
        df, *own, "word_chars", "n_symbols",
        n_words=n.cast("long"), n_lines=F.size("lines").cast("long"), n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        windows=F.when(n >= w, F.transform(F.sequence(F.lit(1), n - w + 1), lambda i: F.xxhash64(F.slice("words", i, w)))).otherwise(none),
    )
    counts = [*own, "word_chars", "n_symbols", "n_words", "n_lines", "n_dup_lines"]
    again = F.size(F.array_distinct("windows")) < F.size("windows")
    by_hash = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = _keep(df, *counts, sorted=F.when(again, by_hash).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    same = lambda k, other: F.coalesce(F.get("sorted", k)["h"] == F.get("sorted", other)["h"], F.lit(False))
    twice = F.filter(F.sequence(F.lit(0), F.size("sorted") - 1), lambda k: same(k, k - 1) | same(k, k + 1))
    starts = F.when(F.size("sorted") > 0, F.sort_array(F.transform(twice, lambda k: F.get("sorted", k)["i"]))).otherwise(F.array().cast("array<int>"))
    df = _keep(df, *counts, starts=starts)
    m = F.size("starts")
    steps = F.transform(F.sequence(F.lit(1), m - 1), lambda k: F.least(F.lit(w), F.get("starts", k) - F.get("starts", k - 1)))
    repeated = F.when(m > 1, F.aggregate(steps, F.lit(w), lambda a, b: a + b)).otherwise(F.lit(0)).cast("long")
    return df.select(F.col("_id").alias(id), F.col("_lang").alias(lang), F.col("_source").alias(source), *counts[3:], repeated.alias("n_repeat_words"))


def _rates(df: DataFrame) -> DataFrame:
    words = F.when(F.col("n_words") > 0, F.col("n_words"))
    return df.withColumns({
        "word_length": F.col("word_chars") / words, "symbol_rate": F.col("n_symbols") / words,
        "dup_line_rate": F.col("n_dup_lines") / F.when(words.isNotNull(), F.col("n_lines")), "repeat_rate": F.col("n_repeat_words") / words,
    })


def _base_failed(rules: Rules) -> Column:
    return (F.col("n_words") < rules.least_words) | (100 * F.col("n_repeat_words") > rules.most_repeated * F.col("n_words"))


def thresholds(rated: DataFrame, rules: Rules, lang: str, source: str) -> DataFrame:
    """By language and source, ``<rate>_low`` and ``<rate>_high`` of each rate."""
    names = [*rules.rates, *sorted(set(rules.units.values()))]
    of = lambda c: F.when(~_base_failed(rules), F.col(c).cast("double"))
    own = rated.groupBy(F.col(lang).alias("_lang"), F.col(source).alias("_source")).agg(F.count(of(names[0])).alias("_n"), *(F.kll_sketch_agg_double(of(r), rules.accuracy).alias(r) for r in names))
    own = scratch.table(own)  # one row for each group

    def merged(*by: str) -> DataFrame:
        return own.groupBy(*by).agg(F.sum("_n").alias("_n"), *(F.kll_merge_agg_double(r).alias(r) for r in names))

    def bounds(df: DataFrame, prefix: str, *by: str) -> DataFrame:
        out = [F.col("_n").alias(f"{prefix}n")]
        for r, least in rules.rates.items():
            q = F.when(F.col("_n") > 0, F.kll_sketch_get_quantile_double(r, F.array(F.lit(0.25), F.lit(0.75), F.lit(rules.upper))))
            width = F.greatest(F.get(q, F.lit(1)) - F.get(q, F.lit(0)), F.lit(least)) * rules.reach
            high = F.get(q, F.lit(1)) + width
            if r in rules.units:
                size = F.when(F.col("_n") > 0, F.kll_sketch_get_quantile_double(rules.units[r], F.lit(0.5)))
                event = 2 * rules.window if r == "repeat_rate" else 1  # words of a window and its copy
                high = F.greatest(high, F.get(q, F.lit(2))) + F.lit(float(rules.events * event)) / size
            out += [(F.get(q, F.lit(0)) - width).alias(f"{prefix}{r}_low"), high.alias(f"{prefix}{r}_high")]
        return df.select(*by, *out)

    of_pair = bounds(own, "p_", "_lang", "_source")
    of_lang = bounds(merged("_lang"), "l_", F.col("_lang").alias("_lang2"))
    of_all = bounds(merged(), "a_")
    joined = of_pair.join(of_lang, F.col("_lang").eqNullSafe(F.col("_lang2"))).join(F.broadcast(of_all))  # one row
    pick = lambda c: F.when(F.col("p_n") >= rules.least_rows, F.col(f"p_{c}")).when(F.col("l_n") >= rules.least_rows, F.col(f"l_{c}")).otherwise(F.col(f"a_{c}"))
    return joined.select("_lang", "_source", *(pick(f"{r}_{side}").alias(f"{r}_{side}") for r in rules.rates for side in ("low", "high")))


def judge(docs: DataFrame, rules: Rules = Rules(), id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """id, the counts of :func:`features`, ``base_failed`` and ``kept``."""
    rated = _rates(scratch.table(features(docs, rules, id, text, lang, source)))
    limits = thresholds(rated, rules, lang, source)
    failed = _base_failed(rules)
    inside = F.lit(True)
    for r in rules.rates:
        inside &= F.coalesce(F.col(r) <= F.col(f"{r}_high"), F.lit(True))
        if r in rules.two_sided:
            inside &= F.coalesce(F.col(r) >= F.col(f"{r}_low"), F.lit(True))
    joined = rated.join(limits, rated[lang].eqNullSafe(limits["_lang"]) & rated[source].eqNullSafe(limits["_source"]), "left")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return joined.select(rated[id], *counts, failed.alias("base_failed"), (~failed & inside).alias("kept"))
