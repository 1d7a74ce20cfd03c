"""Quality rules: base counts and Jensen-Shannon distance to language references, native operations only.

Each text gives two histograms: character classes, and the common words of its language with all
other words in one bin. The references are the same histograms summed over all documents of the
language that pass the base rules. A text whose Jensen-Shannon distance (base 2, so 0 to 1) to its
reference exceeds a limit is rejected. Guards: texts too short for a stable histogram are not judged
by it, nor are languages without word lists (characters only) or with too little text for a reference.

Defined results: a null text has no words and fails the base rules; an unknown or null language is
compared by characters with the documents of that same language; rows are judged one by one, so
repeats are judged alike; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cropwind.sources.paths import written

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
WINDOW = 3
#: Words below which a word histogram says too little; characters are judged from MIN_WORDS on.
MIN_WORDS_FOR_HISTOGRAM = 100
#: Words that a language's reference must rest on.
MIN_REFERENCE_WORDS = 2_000
#: Limits of a long text; a text of n words may be farther by the allowance divided by n, as short
#: histograms scatter.
MAX_CHARACTER_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.25
CHARACTER_ALLOWANCE = 3.0
WORD_ALLOWANCE = 6.0

WORD = r"[^\x20\x09-\x0D]+"
#: Character classes counted by pattern; white space and symbols come with the base counts, what is left is the last class.
CLASSES = (r"\p{Lu}", r"\p{Nd}", r"[.,;:!?'\"()\-]")
#: Very common words of four languages.
COMMON_WORDS = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "ist"),
    "en": ("the", "of", "and", "to", "a", "in", "is", "that", "it", "was", "for", "on"),
    "es": ("de", "la", "que", "el", "en", "y", "los", "del", "se", "las", "por", "un"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "est"),
}
#: A dot for other words, then one letter for each place in a list.
CODES = ".abcdefghijkl"


def _lists(lang: Column) -> Column:
    out = F.array().cast("array<string>")
    for name, words in COMMON_WORDS.items():
        out = F.when(lang == name, F.array(*map(F.lit, words))).otherwise(out)
    return out


def counted(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts, ``q_lang`` and the two histograms ``q_chars`` and ``q_words``.

    Each step's arrays are columns of their own before a lambda reads them, as an expression inside a
    lambda is evaluated once an element. The last step generates the results as one row, so that no
    later filter is pushed below it and takes the arrays apart again.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    a = docs.withColumns({"q_text": text, "q_lang": F.col("lang"), "q_common": _lists(F.col("lang"))})
    b = a.withColumns({
        "q_list": F.regexp_extract_all("q_text", F.lit(WORD), 0),
        "q_lines": F.filter(F.split("q_text", "\n", -1), lambda line: line.rlike(WORD)),
    })
    # A letter for each word: its place in the list of common words, or a dot.
    code = lambda w: F.substr(F.lit(CODES), (F.array_position("q_common", F.lower(w)) + 1).cast("int"), F.lit(1))
    c = b.withColumns({
        "q_n": F.size("q_list").cast("long"),
        "q_word_chars": F.char_length(F.array_join("q_list", "")).cast("long"),
        "q_symbols": F.regexp_count("q_text", F.lit(r"[#*$%&|<>]")).cast("long"),
        "q_dup": (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
        "q_hashes": F.slice(
            F.transform("q_list", lambda w, i: F.xxhash64(w, *(F.get("q_list", i + k) for k in range(1, WINDOW)))),
            1, F.greatest(F.size("q_list") - (WINDOW - 1), F.lit(0)),
        ),
        "q_codes": F.when(F.size("q_common") > 0, F.replace(F.array_join(F.transform("q_list", code), ""), F.lit("."), F.lit(""))),
        "q_upper": F.regexp_count("q_text", F.lit(CLASSES[0])),
        "q_digits": F.regexp_count("q_text", F.lit(CLASSES[1])),
        "q_marks": F.regexp_count("q_text", F.lit(CLASSES[2])),
        "q_length": F.char_length("q_text"),
    }).drop("q_list", "q_lines", "q_text")
    # Only texts with a repeated window are sorted by window.
    repeated = F.size(F.array_distinct("q_hashes")) < F.size("q_hashes")
    pairs = F.sort_array(F.transform("q_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = c.withColumn("q_pairs", F.when(repeated, pairs))
    same = F.filter("q_pairs", lambda p, k: F.coalesce(p["h"] == F.get("q_pairs", k - 1)["h"], F.lit(False)) | F.coalesce(p["h"] == F.get("q_pairs", k + 1)["h"], F.lit(False)))
    e = d.withColumn("q_places", F.sort_array(F.transform(same, lambda p: p["i"])))
    steps = F.transform("q_places", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("q_places", k + 1) - p, F.lit(WINDOW))))
    covered = F.coalesce(F.aggregate(steps, F.lit(0), lambda x, y: x + y), F.lit(0)).cast("long")
    known = [F.col(x).cast("double") for x in ("q_upper", "q_digits", "q_marks", "q_symbols")]
    known.append((F.col("q_length") - F.col("q_word_chars")).cast("double"))
    rest = F.greatest(F.col("q_length") - sum(known), F.lit(0.0))
    common = [(F.char_length("q_codes") - F.char_length(F.replace("q_codes", F.lit(x), F.lit("")))).cast("double") for x in CODES[1:]]
    bins = F.when(F.col("q_codes").isNotNull(), F.array(*common, (F.col("q_n") - F.char_length("q_codes")).cast("double")))
    result = F.struct(
        F.col("q_n").alias("n_words"), F.col("q_word_chars").alias("word_chars"), F.col("q_symbols").alias("n_symbols"),
        F.col("q_dup").alias("n_dup_lines"), covered.alias("n_repeat_words"), F.array(*known, rest).alias("q_chars"), bins.alias("q_words"),
    )
    return e.select(*docs.columns, "q_lang", F.inline(F.array(result)))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def references(counts: DataFrame) -> DataFrame:
    """``r_lang, r_chars, r_words`` with the summed histograms of each language."""
    bins_c, bins_w = len(CLASSES) + 3, len(CODES)
    sums = [F.sum(F.get("q_chars", F.lit(i))).alias(f"c{i}") for i in range(bins_c)] + [F.sum(F.get("q_words", F.lit(i))).alias(f"w{i}") for i in range(bins_w)]
    out = counts.where(~base_failed()).groupBy(F.col("q_lang").alias("r_lang")).agg(F.sum("n_words").alias("r_total"), *sums)
    return out.where(F.col("r_total") >= MIN_REFERENCE_WORDS).select(
        "r_lang", F.array(*(f"c{i}" for i in range(bins_c))).alias("r_chars"), F.array(*(f"w{i}" for i in range(bins_w))).alias("r_words")
    )


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms; null if one is empty or missing."""
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda x, y: x + F.coalesce(y, F.lit(0.0)))
    shares = lambda h: F.transform(h, lambda x: F.try_divide(F.coalesce(x, F.lit(0.0)), total(h)))

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2.0 * x / (x + y))).otherwise(0.0)

    pieces = F.zip_with(shares(counts), shares(reference), lambda x, y: part(x, y) + part(y, x))
    divergence = F.aggregate(pieces, F.lit(0.0), lambda x, y: x + y) / 2
    return F.when((total(counts) > 0) & (total(reference) > 0), F.sqrt(F.greatest(divergence, F.lit(0.0))))


def judged(counts: DataFrame, reference: DataFrame) -> DataFrame:
    """``counts`` with ``char_distance``, ``word_distance``, ``base_failed`` and ``kept``."""
    # One row a language: Spark sends it along if it is small and splits a hot language if not.
    rows = counts.join(reference, F.col("q_lang").eqNullSafe(F.col("r_lang")), "left")
    rows = rows.withColumns({
        "char_distance": distance(F.col("q_chars"), F.col("r_chars")),
        "word_distance": F.when(F.col("n_words") >= MIN_WORDS_FOR_HISTOGRAM, distance(F.col("q_words"), F.col("r_words"))),
        "base_failed": base_failed(),
    })
    scatter = F.try_divide(F.lit(1.0), F.col("n_words"))
    far = F.coalesce(F.col("char_distance") > MAX_CHARACTER_DISTANCE + CHARACTER_ALLOWANCE * scatter, F.lit(False))
    far |= F.coalesce(F.col("word_distance") > MAX_WORD_DISTANCE + WORD_ALLOWANCE * scatter, F.lit(False))
    return rows.withColumn("kept", ~F.col("base_failed") & ~far).drop("q_lang", "q_chars", "q_words", "r_lang", "r_chars", "r_words")


def digest(docs: DataFrame) -> DataFrame:
    """Counts and verdict of every document."""
    counts = written(counted(docs.select("doc_id", "text", "lang")).drop("text", "lang"), "quality-counts")
    return judged(counts, references(counts))


def stage(docs: DataFrame) -> DataFrame:
    """The documents that are kept."""
    named = docs.select(*(F.col(f"`{c}`").alias(c if c in ("text", "lang") else f"own_{i}") for i, c in enumerate(docs.columns)))
    # Written with the texts, so that these are counted once, for the references and for the verdicts.
    counts = written(counted(named), "quality-counts")
    # Written too, so that Spark knows how small it is before it plans the join, and moves no texts by language.
    kept = judged(counts, written(references(counts), "quality-references")).where("kept")
    return kept.select(*(F.col(c if c in ("text", "lang") else f"own_{i}").alias(c) for i, c in enumerate(docs.columns)))
