"""Quality rules as a short-circuit cascade (operator 4), in DataFrame functions only.

The base measures are computed for every document. The rules are then tried
one after another, as one CASE that stops at the first rule that rejects; the
order comes from a random sample of the whole table, on which each rule's cost
(median time of its evaluation on a row, read from a clock before and after it)
and selectivity (share of rows it rejects) are estimated in one pass: most
rejections for each unit of cost first. The order changes how fast a document
is rejected, never whether it is.

Defined cases: null text has no words; a document without words fails the
base; lines are split at \\n only; a null doc_id stays null; repeated rows each
get an output row; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsight.llm.tables import own_columns

# Fixed values of the contract: what a word is, what a symbol is, base limits.
SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", "#*$%&|<>"
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50

#: Expected rows of the sample on which costs and selectivities are estimated; every row of the table is as likely to be in it.
SAMPLE_ROWS = 2000
#: Windows of texts of up to 2 ** POSITION_BITS words are sorted as single numbers, of hash and position.
POSITION_BITS = 20


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once for each row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text; one empty word if it has none."""
    return F.split(F.btrim(text, F.lit(" \t\n\x0b\x0c\r")), SPACE)


def covered(positions: Column) -> Column:
    """Words in the 3-word windows that start at these ascending positions."""
    return F.aggregate(F.zip_with(positions, F.slice(positions, 2, F.size(positions)), lambda i, j: F.least(F.coalesce(j - i, F.lit(3)), F.lit(3))), F.lit(0).cast("long"), lambda n, x: n + x)


def sorted_windows(words: Column) -> Column:
    """Words in repeated windows, by sorting (hash, words, position): for texts of any length, and where hashes collide."""
    w = words
    rows = F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), F.concat_ws(" ", x, F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("i")))

    def positions(s):
        same = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda x, y: F.when((x["h"] == y["h"]) & (x["t"] == y["t"]), F.array(x["i"], y["i"])))  # null after the last
        return F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))

    return let(let(F.sort_array(rows), positions), covered)


def counted_words(text: Column) -> Column:
    """Struct of n, the words of a text that isn't null, chars, their characters, and repeated, the words in 3-word windows found twice or more.

    Each window is one number, the high bits of its hash and its position, and
    equal windows are neighbours once these are sorted. Neighbours of one hash
    are compared word by word; texts in which two of them differ, or that have
    more words than positions fit in, go the longer way of sorted_windows.
    """
    mask = (1 << POSITION_BITS) - 1

    def repeated(w):
        at = lambda i: F.get(w, i)
        keys = F.sort_array(F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, at(i + 1), at(i + 2)).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long"))))
        place = lambda k: k.bitwiseAND(F.lit(mask)).cast("int")
        equal = lambda i, j: (at(i) == at(j)) & (at(i + 1) == at(j + 1)) & (at(i + 2) == at(j + 2))
        pairs = lambda k: F.filter(F.zip_with(k, F.slice(k, 2, F.size(k)), lambda a, b: F.when(F.shiftrightunsigned(a.bitwiseXOR(b), POSITION_BITS) == 0, F.array(place(a), place(b)))), lambda x: x.isNotNull())
        counted = lambda p: F.when(F.size(p) == 0, F.lit(0).cast("long")).when(F.exists(p, lambda x: ~equal(x[0], x[1])), sorted_windows(w)).otherwise(let(F.sort_array(F.array_distinct(F.flatten(p))), covered))
        return F.when(F.size(w) > mask, sorted_windows(w)).otherwise(let(let(keys, pairs), counted))

    def measured(w):
        return F.struct(F.when(w[0] == "", 0).otherwise(F.size(w)).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars"), F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(repeated(w)).alias("repeated"))

    return let(words_of(text), measured)


def base_measures(docs: DataFrame) -> DataFrame:
    """docs and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (
        # As it depends on the row's place, no filter is pushed below it, where words would be counted once more.
        docs.withColumn("counted", F.when(F.monotonically_increasing_id() >= 0, counted_words(text)))
        .withColumn("n_words", F.col("counted.n"))
        .withColumn("word_chars", F.col("counted.chars"))
        .withColumn("n_symbols", F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long"))
        .withColumn("n_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        .withColumn("n_repeat_words", F.col("counted.repeated"))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")))
        .drop("counted")
    )


def one_word_fills(words: Column, part: int) -> Column:
    """Whether one word is more than a part-th of the words: in sorted order it then meets itself so many places on. Hashes are sorted first, and words only where their hashes say so."""
    meets = lambda s, m: F.exists(F.zip_with(F.slice(s, 1, F.size(s) - m), F.slice(s, m + 1, F.size(s)), lambda a, b: a == b), lambda x: x)
    share = lambda w: F.floor(F.size(w) / part).cast("int")
    return let(words, lambda w: F.when(let(F.sort_array(F.transform(w, lambda x: F.xxhash64(x))), lambda s: meets(s, share(w))), let(F.sort_array(w), lambda s: meets(s, share(w)))).otherwise(False))


def rules() -> dict[str, Column]:
    """Name and rejection condition of each rule; conditions are never null."""
    text, n, chars = F.coalesce("text", F.lit("")), F.col("n_words"), F.col("word_chars")
    found = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return {
        "symbols": 10 * F.col("n_symbols") > n,
        "symbol_chars": 20 * F.col("n_symbols") > chars,
        "word_length": (chars > 12 * n) | (chars < 2 * n),
        "dup_lines": 2 * F.col("n_dup_lines") > F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1,
        "repeats": 100 * F.col("n_repeat_words") > 30 * n,
        "exclamations": 10 * (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))) > n,
        "capitals": 10 * found("[A-ZÀ-ÖØ-Þ]") > 3 * chars,
        "digits": 10 * found("[0-9]") > 3 * chars,
        "one_word": one_word_fills(words_of(text), 5),
    }


def rule_estimates(docs: DataFrame, conditions: dict[str, Column], sample_rows: int = SAMPLE_ROWS) -> dict[str, tuple[float, float]]:
    """For each rule its median cost on a row (nanoseconds) and the share of rows it rejects, of a random sample of those that the base passes.

    The sample has about sample_rows rows, drawn from all partitions alike. An
    array evaluates its members in order, so the clock is read between rules.
    """
    total = docs.count()
    sample = docs.select("text").sample(min(1.0, sample_rows / total), seed=4) if total else docs.select("text")
    rows = base_measures(sample).filter("not base_failed").cache()
    try:
        clock = F.java_method(F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")
        steps = [x for c in conditions.values() for x in (clock, c.cast("long"))]
        timed = rows.select(F.array(*steps, clock).alias("s"))
        found = timed.agg(*[x for k in range(len(conditions)) for x in (F.percentile_approx(F.col("s")[2 * k + 2] - F.col("s")[2 * k], 0.5), F.avg(F.col("s")[2 * k + 1]))]).first()
        return {name: (float(max(found[2 * k] or 0, 1)), float(found[2 * k + 1] or 0.0)) for k, name in enumerate(conditions)}
    finally:
        rows.unpersist()


def cascade_order(docs: DataFrame, conditions: dict[str, Column], sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rule names, most rejections for each unit of cost first; then the cheaper first, then by name."""
    found = rule_estimates(docs, conditions, sample_rows)
    return sorted(conditions, key=lambda name: (-found[name][1] / found[name][0], found[name][0], name))


def quality_rules(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rejected_by."""
    texts, conditions = own_columns(docs, ["doc_id", "text"]), rules()
    measured = base_measures(texts)
    order = order or cascade_order(texts, conditions)
    verdict = F.when(F.col("base_failed"), "base")
    for name in order:
        verdict = verdict.when(conditions[name], name)
    return measured.withColumn("rejected_by", verdict).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")
