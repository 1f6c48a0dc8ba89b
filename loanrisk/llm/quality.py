"""Quality rules by distribution divergence (operator 2, native).

Per document, from the whole text: counts of the base rules, the counts of seven
character classes, and how often each of a fixed list of common words occurs
(words of letters only, in lower case; the rest is one bin "other").

*References.* Each language of ``COMMON_WORDS`` has one: the sums of both histograms
over its reference texts. These are labelled with the language, pass the base rules,
are long enough to be judged, and at least ``REFERENCE_PERCENT`` of their words are on
the language's own list; so noise makes no reference, whatever its label says. A text
is never judged by itself: its own counts are taken out of its language's sums. A
reference counts from ``MIN_REFERENCE_TEXTS`` other texts on.

*Rules.* The distance is Jensen-Shannon's, the square root of the divergence in bits
(0 to 1). A text is compared with every reference and needs one that is near, so a
wrong label costs nothing. Its character classes must be within
``MAX_CLASS_DISTANCE``. The limit for common words follows from each reference: the
distance of a text that holds the same common words ``1 / DILUTION`` as often. A text
with fewer than that, or with others, is beyond it. A distance is only judged from a
minimum length on (``MIN_CHARS``, ``MIN_DISTANCE_WORDS``): a short text's histogram is
far from any reference by chance.

One pass over the texts writes a narrow table; references are sums over it (partial
sums in each task), one row in all, joined back to it.

Defined results: null text is empty (no words, so it fails the base rules); texts
without a language or with one that has no list make no reference and are judged by
the others; without any reference the base rules decide alone; equal or null ids are
separate rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanrisk.llm.common import text_or_empty, written

WORD = r"[^\x20\x09-\x0D]"
WINDOW = 5
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Least characters for the class distance and least words for the word distance.
MIN_CHARS, MIN_DISTANCE_WORDS = 200, 60
MAX_CLASS_DISTANCE, DILUTION = 0.30, 20
REFERENCE_PERCENT, MIN_REFERENCE_TEXTS = 10, 20

# The most frequent function words of four languages.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not",
           "this", "are", "from"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht",
           "ein", "eine", "als", "auch"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "plus",
           "pas", "au", "sur"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para",
           "es", "al"],
}

#: All common words, the order of the histogram.
COMMON = sorted({w for words in COMMON_WORDS.values() for w in words})

# The characters that a class leaves when all others are deleted.
CLASSES = {
    "upper": "A-Z",
    "digit": "0-9",
    "stop": r".,;:!?",
    "symbol": r"#*$%&|<>@^~_=+/\\{}\[\]",
    "beyond_ascii": r"\x{80}-\x{10FFFF}",
}


def count_of(text: Column, chars: str) -> Column:
    """Characters of a class: what is left when runs of all others are deleted."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")


def _windows(words: Column, hashes: Column) -> Column:
    """(hash, place) of each window, sorted."""
    return F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def document_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts of each document's whole text, and its two histograms."""
    d = df.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), text_or_empty(text_col).alias("text"))
    d = d.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    n = F.size("words")
    hashes = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(
        *[F.get("words", i + k) for k in range(WINDOW)])))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD))
    plain = F.array_remove(F.split(F.lower("text"), r"[^\p{L}]+"), "")
    # most of a text is plain small letters and spaces; the classes are counted in what is left
    rest = F.regexp_replace("text", r"[a-z\x20\x09-\x0D]+", "")
    d = d.withColumns({"hashes": hashes, "lines": lines, "plain": plain, "rest": rest})
    d = d.withColumns({
        "repeats": F.coalesce(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.lit(False)),
        "common": F.sort_array(F.filter("plain", lambda w: w.isin(*COMMON))),
        "n_plain": F.size("plain").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
    })
    d = d.withColumn("sorted", F.when(F.col("repeats"), _windows(F.col("words"), F.col("hashes"))))

    def same(a: Column, b: Column) -> Column:
        """Equal windows: by hash, then by their words."""
        return (a["h"] == b["h"]) & (F.slice("words", a["i"] + 1, WINDOW) == F.slice("words", b["i"] + 1, WINDOW))

    twice = F.filter("sorted", lambda s, k: F.coalesce(same(s, F.get("sorted", k - 1)), F.lit(False))
                     | F.coalesce(same(s, F.get("sorted", k + 1)), F.lit(False)))
    d = d.withColumn("places", F.sort_array(F.transform(twice, lambda s: s["i"])))
    # each window adds the words that the window before it does not hold
    covered = F.aggregate("places", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")), lambda acc, i: F.struct(
        (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")), lambda acc: acc["n"])
    # of the sorted common words, where each begins: (word, times)
    d = d.withColumn("heads", F.filter(F.sequence(F.lit(0), F.size("common")), lambda i: (i < F.size("common")) & (
        (i == 0) | (F.get("common", i) != F.get("common", i - 1)))))
    histogram = F.transform("heads", lambda i, k: F.struct(
        F.get("common", i).alias("w"), (F.coalesce(F.get("heads", k + 1), F.size("common")) - i).cast("long").alias("n")))
    text = F.col("text")
    classes = {name: count_of(F.col("rest"), chars) for name, chars in CLASSES.items()}
    out = d.select("doc_id", "lang", n.cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
                   count_of(F.col("rest"), "#*$%&|<>").alias("n_symbols"), "n_dup_lines",
                   F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_plain", histogram.alias("histogram"),
                   F.length(text).cast("long").alias("n_chars"), *[c.alias(name) for name, c in classes.items()])
    known = sum((F.col(c) for c in CLASSES), F.col("n_chars") - F.col("word_chars"))
    return out.withColumns({"space": F.col("n_chars") - F.col("word_chars"), "lower": F.greatest(F.col("n_chars") - known, F.lit(0))})


BINS = [*CLASSES, "space", "lower"]


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def is_reference() -> Column:
    """A text that its language's reference is made of."""
    own = F.lit(False)
    for lang, words in COMMON_WORDS.items():
        mine = F.aggregate(F.filter("histogram", lambda e: e["w"].isin(*words)), F.lit(0).cast("long"), lambda acc, e: acc + e["n"])
        own = F.when(F.col("lang") == lang, 100 * mine >= REFERENCE_PERCENT * F.col("n_plain")).otherwise(own)
    return own & ~base_failed() & (F.col("n_chars") >= MIN_CHARS) & (F.col("n_plain") >= MIN_DISTANCE_WORDS)


def references(counts: DataFrame) -> DataFrame:
    """One row: ``refs``, an array with an entry a language: ``lang, texts, chars, words,
    classes`` (sums in the order of BINS) and ``common`` (sums in the order of COMMON)."""
    texts = counts.filter("is_reference")
    sums = texts.groupBy("lang").agg(F.count("*").alias("texts"), F.sum("n_chars").alias("chars"), F.sum("n_plain").alias("words"),
                                     F.array(*[F.sum(b) for b in BINS]).alias("classes"))
    common = (texts.select("lang", F.explode("histogram").alias("e")).groupBy("lang", "e.w").agg(F.sum("e.n").alias("n"))
              .groupBy(F.col("lang").alias("l")).agg(F.map_from_entries(F.collect_list(F.struct("w", "n"))).alias("by_word")))
    filled = F.transform(F.lit(COMMON), lambda w: F.coalesce(F.element_at("by_word", w), F.lit(0).cast("long")))
    each = sums.join(common, F.col("lang") == F.col("l")).select("lang", "texts", "chars", "words", "classes", filled.alias("common"))
    return each.agg(F.array_sort(F.collect_list(F.struct("lang", "texts", "chars", "words", "classes", "common"))).alias("refs"))


def _half(p: Column, q: Column) -> Column:
    """p log2 of p over the mean of p and q; 0 where p is 0."""
    return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)


def _term(p: Column, q: Column) -> Column:
    return (_half(p, q) + _half(q, p)) / 2


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def _distance(p: Column, q: Column) -> Column:
    return F.sqrt(F.greatest(_total(F.zip_with(p, q, _term)), F.lit(0.0)))


def _shares(counts: Column, whole: Column) -> Column:
    return F.transform(counts, lambda n: n / whole)


def _with_rest(shares: Column) -> Column:
    return F.concat(shares, F.array(1 - _total(shares)))


def _let(value: Column, then) -> Column:
    return F.element_at(F.transform(F.array(value), then), 1)


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            max_class_distance: float = MAX_CLASS_DISTANCE, dilution: float = DILUTION) -> DataFrame:
    """A row per document: the base counts, ``base_failed``, ``kept``, the least
    ``class_distance``, and ``word_distance, word_limit`` of the reference whose limit it
    keeps best (null below the least length and without references)."""
    counts = written(document_counts(df, id_col, text_col, lang_col).withColumn("is_reference", is_reference()), "quality-counts")
    refs = written(references(counts), "quality-references")
    d = counts.crossJoin(F.broadcast(refs))  # one row, an entry a language
    # without the text's own counts, where it is one of the reference's
    dense = _let(F.map_from_entries("histogram"), lambda m: F.transform(
        F.lit(COMMON), lambda w: F.coalesce(F.element_at(m, w), F.lit(0).cast("long"))))
    d = d.withColumns({"classes": F.array(*[F.col(b) for b in BINS]), "common": dense})

    def made_of(r):
        return F.coalesce(F.col("is_reference") & (r["lang"] == F.col("lang")), F.lit(False))

    def others(r):
        mine = made_of(r).cast("long")
        return F.struct(_shares(F.zip_with(r["classes"], "classes", lambda a, b: a - mine * b), r["chars"] - mine * F.col("n_chars")).alias("classes"),
                        _shares(F.zip_with(r["common"], "common", lambda a, b: a - mine * b), r["words"] - mine * F.col("n_plain")).alias("common"))

    enough = F.filter("refs", lambda r: r["texts"] - made_of(r).cast("long") >= MIN_REFERENCE_TEXTS)
    d = d.withColumn("others", F.transform(enough, others))
    class_p, word_p = _shares(F.col("classes"), F.col("n_chars")), _with_rest(_shares(F.col("common"), F.col("n_plain")))
    d = d.withColumns({"class_p": F.when(F.col("n_chars") >= MIN_CHARS, class_p),
                       "word_p": F.when(F.col("n_plain") >= MIN_DISTANCE_WORDS, word_p)})

    def words(r):
        limit = _distance(_with_rest(F.transform(r["common"], lambda q: q / dilution)), _with_rest(r["common"]))
        return _let(F.struct(_distance(F.col("word_p"), _with_rest(r["common"])).alias("d"), limit.alias("l")),
                    lambda x: F.struct((x["d"] / x["l"]).alias("ratio"), x["d"].alias("distance"), x["l"].alias("limit")))

    d = d.withColumns({
        "base_failed": base_failed(),
        "class_distance": F.when(F.col("class_p").isNotNull(), F.array_min(F.transform("others", lambda r: _distance(F.col("class_p"), r["classes"])))),
        "word": F.when(F.col("word_p").isNotNull(), F.array_min(F.transform("others", words)))})
    near = (F.coalesce("class_distance", F.lit(0.0)) <= max_class_distance) & (F.coalesce("word.ratio", F.lit(0.0)) <= 1)
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                    (~F.col("base_failed") & near).alias("kept"), "class_distance", F.col("word.distance").alias("word_distance"),
                    F.col("word.limit").alias("word_limit"))
