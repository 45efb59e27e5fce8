"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Words are runs without ASCII white space, lines are split at newlines.  A null text has no words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Common words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was on are with as be this from or by at an not "
    "le la les de des et un une en du que qui dans pour est sur pas au avec par "
    "der die das und den von zu mit ist im nicht ein eine auf für sich dem als auch es "
    "el los las del y por con para se su lo como no una al"
).split()

MIN_WORDS, WINDOW, REPEAT_PERCENT = 10, 5, 20


@dataclass(frozen=True)
class Rule:
    """A text passes if the metric lies between the limits (None: no limit)."""

    metric: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbols_per_word", None, 0.1),
    Rule("stop_word_share", 0.01, None),
    Rule("upper_word_share", None, 0.5),
    Rule("dup_line_share", None, 0.5),
    Rule("bullet_line_share", None, 0.9),
    Rule("ellipsis_line_share", None, 0.3),
)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _with_counts(docs: DataFrame, text: str, at: str) -> DataFrame:
    """docs with the words, lines and words in repeated windows, in columns of the prefix ``at``."""
    body = F.coalesce(F.col(text), F.lit(""))
    words, lines, hashes, again, places = (f"{at}{c}" for c in ("words", "lines", "hashes", "again", "places"))
    out = docs.withColumn(words, F.filter(F.split(body, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    out = out.withColumn(lines, F.filter(F.split(body, r"\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    # a window's hash is that of its words' hashes; equal windows have equal ones, and most texts have none that is equal
    n = F.size(words)
    starts = F.sequence(F.lit(0), n - WINDOW)
    out = out.withColumn(hashes, F.transform(words, lambda w: F.xxhash64(w)))
    window = F.transform(starts, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))
    out = out.withColumn(hashes, F.when(n >= WINDOW, window).otherwise(F.array().cast("array<bigint>")))
    repeated = F.size(F.array_distinct(hashes)) < F.size(hashes)
    # where some are, the windows of equal hashes are neighbours once sorted, and only they are compared as strings
    out = out.withColumn(again, F.when(repeated, F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = f"filter(transform({again}, (x, k) -> IF(x.h <=> get({again}, k - 1).h OR x.h <=> get({again}, k + 1).h, x.i, NULL)), i -> i IS NOT NULL)"
    out = out.withColumn(again, F.expr(f"array_sort(transform({near}, i -> struct(array_join(slice({words}, i + 1, {WINDOW}), ' ') AS w, i AS i)))"))
    placed = F.expr(f"transform({again}, (x, k) -> IF(x.w <=> get({again}, k - 1).w OR x.w <=> get({again}, k + 1).w, x.i, NULL))")
    out = out.withColumn(places, F.sort_array(F.filter(placed, lambda i: i.isNotNull())))
    # a window covers five words, or those up to the next repeated window's start
    covered = F.expr(f"aggregate(zip_with({places}, slice({places}, 2, greatest(size({places}), 1)), (a, b) -> least({WINDOW}, coalesce(b - a, {WINDOW}))), 0L, (s, x) -> s + x)")
    return out.withColumn(f"{at}repeat", F.when(F.size(places) > 0, covered).otherwise(F.lit(0)).cast("long"))


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", column: str = "quality") -> DataFrame:
    """docs with a struct: the base counts, base_failed, every metric, the rules broken and kept; it takes the place of an
    input column of that name.

    Null and empty texts fail for want of words; very long texts count whole; repeated rows get a result each.
    """
    at = "__"
    while any(c.lower().startswith(at) for c in docs.columns):  # working columns never meet those of the input
        at += "_"
    out = _with_counts(docs, text, at)
    words, all_lines = F.col(f"{at}words"), F.col(f"{at}lines")
    n, lines = F.size(words).cast("long"), F.size(all_lines).cast("long")
    body = F.coalesce(F.col(text), F.lit(""))
    base = {
        "n_words": n,
        "word_chars": F.aggregate(words, F.lit(0).cast("long"), lambda s, w: s + F.char_length(w)),
        "n_symbols": F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": lines - F.size(F.array_distinct(all_lines)),
        "n_repeat_words": F.col(f"{at}repeat"),
    }
    bare = F.transform(words, lambda w: F.lower(F.rtrim(w, F.lit(".,;:!?"))))
    metrics = {
        "mean_word_chars": _share(base["word_chars"], n),
        "symbols_per_word": _share(base["n_symbols"], n),
        "stop_word_share": _share(F.size(F.filter(bare, lambda w: w.isin(STOP_WORDS))), n),
        "upper_word_share": _share(F.size(F.filter(words, lambda w: w.rlike(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$"))), n),
        "dup_line_share": _share(base["n_dup_lines"], lines),
        "bullet_line_share": _share(F.size(F.filter(all_lines, lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))), lines),
        "ellipsis_line_share": _share(F.size(F.filter(all_lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09\x0D]*$"))), lines),
    }
    failed = (n < MIN_WORDS) | (base["n_repeat_words"] * 100 > n * REPEAT_PERCENT)
    out = out.withColumn(f"{at}base", F.struct(*[c.alias(k) for k, c in base.items()], failed.alias("base_failed")))
    out = out.withColumn(f"{at}metrics", F.struct(*[c.cast("double").alias(k) for k, c in metrics.items()]))

    def breaks(rule: Rule) -> Column:
        value = F.col(f"{at}metrics.{rule.metric}")
        return (value < rule.least if rule.least is not None else F.lit(False)) | (value > rule.most if rule.most is not None else F.lit(False))

    broken = F.array_compact(F.array(*[F.when(breaks(r), F.lit(r.metric)) for r in rules])) if rules else F.array().cast("array<string>")
    result = F.struct(f"{at}base.*", f"{at}metrics.*", broken.alias("broken"), (~F.col(f"{at}base.base_failed") & (F.size(broken) == 0)).alias("kept"))
    return out.withColumn(column, result).drop(*[f"{at}{c}" for c in ("words", "lines", "hashes", "again", "places", "repeat", "base", "metrics")])
