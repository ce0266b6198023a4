"""Quality rules: a table of thresholds compiled into one projection (operator 6)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklore.llm.common import SPACES, WORD, text_or_empty

# Characters that count as symbols, and frequent function words of English, French, German and Spanish.
SYMBOLS = "#*$%&|<>"
STOP_WORDS = [
    "the", "and", "of", "to", "in", "is", "that", "it", "was", "for", "on", "with", "as", "by", "this", "be", "at", "are", "or", "an",
    "le", "la", "les", "de", "des", "du", "un", "une", "et", "en", "que", "qui", "dans", "pour", "par", "sur", "est", "pas", "avec", "au",
    "der", "die", "das", "und", "ist", "ein", "eine", "zu", "den", "von", "mit", "nicht", "auf", "dem", "sich", "es", "für", "im", "sie", "er",
    "el", "los", "las", "y", "una", "por", "con", "para", "se", "no", "su", "lo", "del", "al", "o", "como",
]


@dataclass(frozen=True)
class Rule:
    """A document fails if the ratio of two metrics is outside [low, high]; it applies from `least` words on."""

    name: str
    over: str
    under: str
    low: float | None = None
    high: float | None = None
    least: int = 0


#: The threshold table. Ratios are compared by multiplication, so a zero denominator fails nothing.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", low=2.0, high=15.0),
    Rule("symbols_to_words", "n_symbols", "n_words", high=0.25),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.6),
    Rule("stop_words", "n_stop_words", "n_words", low=0.02, least=30),
)

# The words and the lines are made once; every metric below is an expression over them.
METRICS = {
    "n_words": "size(words)",
    "word_chars": "length(array_join(words, ''))",
    "n_symbols": "n_symbols",
    "n_lines": "size(lines)",
    "n_dup_lines": "size(lines) - size(array_distinct(lines))",
    "n_stop_words": f"size(filter(words, w -> lower(w) in ({', '.join(map(repr, STOP_WORDS))})))",
}
WINDOW = 5
#: Hashes of the windows in order of their start, built from pairs. Two unequal windows of one text get one hash with a
#: chance of about 2^-62 a pair.
HASHES = {
    "h1": "transform(words, w -> xxhash64(w))",
    "h2": "zip_with(h1, slice(h1, 2, n_words), (a, b) -> xxhash64(a, b))",
    "h4": "zip_with(h2, slice(h2, 3, n_words), (a, b) -> xxhash64(a, b))",
    "grams": f"slice(zip_with(h4, slice(h1, {WINDOW}, n_words), (a, b) -> xxhash64(a, b)), 1, greatest(n_words - {WINDOW - 1}, 0))",
}
#: Starts of the windows found twice or more: the neighbours in order of (hash, start) tell, without comparing all pairs.
SORTED = "sort_array(transform(grams, (g, i) -> struct(g as g, i as i)))"
STARTS = (
    "sort_array(transform(filter(sorted, (x, k) -> (k > 0 and sorted[greatest(k - 1, 0)].g = x.g)"
    " or (k + 1 < size(sorted) and sorted[least(k + 1, size(sorted) - 1)].g = x.g)), x -> x.i))"
)
COVERED = (
    f"aggregate(starts, struct(0L as n, -{WINDOW} as last), (s, x) -> struct(s.n + least({WINDOW}, x - s.last) as n, x as last), s -> s.n)"
)


def _fails(rule: Rule) -> Column:
    over, under = F.col(rule.over), F.col(rule.under)
    out = F.lit(False)
    if rule.low is not None:
        out = out | (over < under * F.lit(rule.low))
    if rule.high is not None:
        out = out | (over > under * F.lit(rule.high))
    return out & (F.col("n_words") >= rule.least)


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple = ()) -> DataFrame:
    """doc_id, the metrics, base_failed, kept and the names of the failed rules for every row of docs (doc_id, text).

    A null or empty text has no words and fails the base. Rows are independent: repeats give repeats, an empty table
    gives an empty result, and columns other than doc_id, text and those in keep are ignored.
    """
    out = docs.select(*keep, "doc_id", text_or_empty().alias("body"))
    out = out.select(
        *keep,
        "doc_id",
        F.regexp_extract_all("body", F.lit(f"({WORD})"), 1).alias("words"),
        F.filter(F.split("body", "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("lines"),
        (F.length("body") - F.length(F.translate("body", SYMBOLS, ""))).alias("n_symbols"),
    )
    out = out.withColumns({k: F.expr(v).cast("long") for k, v in METRICS.items()})
    out = out.drop("lines")
    for name, made in HASHES.items():
        out = out.withColumn(name, F.expr(made.replace("n_words", "cast(n_words as int)")))
    out = out.withColumn("repeats", F.expr("size(array_distinct(grams)) < size(grams)"))
    repeats = F.col("repeats")
    out = out.withColumn("sorted", F.when(repeats, F.expr(SORTED)))
    out = out.withColumn("starts", F.when(repeats, F.expr(STARTS)))
    out = out.withColumn("n_repeat_words", F.coalesce(F.when(repeats, F.expr(COVERED)), F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = out.withColumn("base_failed", failed)
    named = F.array_compact(F.array(*[F.when(_fails(r), F.lit(r.name)) for r in rules]))
    out = out.withColumn("failed_rules", named)
    return out.select(
        *keep, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), "failed_rules", "n_stop_words", "n_lines",
    )
