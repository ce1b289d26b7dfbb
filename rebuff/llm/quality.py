"""Quality rules by distribution divergence, native expressions only.

Per document two histograms are counted: character classes and common function words. Each language's
reference is the sum of its documents' histograms, over the whole corpus. A document is rejected when
the Jensen-Shannon distance (base 2, 0 to 1) of its character classes to its language's reference
exceeds a limit, or when both distances exceed lower limits at once; short documents, whose histograms
say little, pass these tests. A text that mixes languages is far in words only, and stays.

Defined cases: null or empty text has no words and fails the base rule; a null language has a reference
of its own; repeated rows give repeated results; extra columns are passed through by ``keep_good``.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rebuff.llm.common import broadcast_if_small, materialize, text_key, words

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Minimum-length guards: characters for the class test, words for the common-word test.
MIN_CHARS = 200
MIN_COMMON_WORDS = 50
MAX_CLASS_DISTANCE = 0.25
#: Class and common-word distances that together reject.
JOINT_DISTANCES = (0.155, 0.28)

#: Common function words by language.
COMMON = {
    "en": "the of and to in a is that it for was with on are be this by from or an".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au avec pas".split(),
    "es": "de la que el en y los del se las por un para con no una su al lo como".split(),
}

#: Character classes in the order in which they are taken out of the text.
CLASSES = {"lower": r"\p{Ll}+", "space": r"\s+", "upper": r"\p{Lu}+", "digit": r"\p{Nd}+", "letter": r"[\p{L}\p{M}]+",
           "punct": r"[.,;:!?'\"()\-]+"}


def vocabulary() -> list[str]:
    return sorted({w for group in COMMON.values() for w in group})


def repeated_words(hashes: str, window: int) -> Column:
    """Words covered by windows whose hash occurs at least twice in the array ``hashes``.

    Texts without an equal pair stop at a hash-set size test; the others sort (hash, position) and mark
    equal neighbours.
    """
    order = F.sort_array(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def marked(s: Column) -> Column:
        return F.array_sort(F.transform(F.filter(s, lambda x, k: F.get(s, k - 1)["h"].eqNullSafe(x["h"])
                                                 | F.get(s, k + 1)["h"].eqNullSafe(x["h"])), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")),
                           lambda a, x: F.struct((a["n"] + F.least(F.lit(window), x - a["last"])).alias("n"), x.alias("last")),
                           lambda a: a["n"])
    # A one-element array binds the sorted pairs to a name, so that they are computed once.
    found = F.transform(F.array(order), lambda s: covered(marked(s)))[0]
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), found).otherwise(F.lit(0)).cast("long")


def with_window_hashes(d: DataFrame, words_column: str, window: int) -> DataFrame:
    """Adds ``q_hash``: a 64-bit hash of every window of ``window`` (a power of two) words, built by
    doubling, so that every word is hashed once."""
    d = d.withColumn("q_hash1", F.transform(words_column, lambda w: F.xxhash64(w)))
    k = 1
    while k < window:
        a, m = f"q_hash{k}", F.greatest(F.size(f"q_hash{k}") - k, F.lit(0))
        d = d.withColumn(f"q_hash{2 * k}", F.zip_with(F.slice(a, F.lit(1), m), F.slice(a, F.lit(k + 1), m), lambda x, y: F.xxhash64(x, y)))
        k *= 2
    return d.withColumnRenamed(f"q_hash{window}", "q_hash")


def measure(docs: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The input's columns plus the base measures and the histograms ``q_classes`` and ``q_common``."""
    d = docs.withColumn("q_text", F.coalesce(F.col(text), F.lit("")))
    d = d.withColumn("q_words", words(F.col("q_text")))
    d = d.withColumn("q_lines", F.filter(F.split("q_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    names = list(CLASSES)
    for k, name in enumerate(names):
        d = d.withColumn(f"q_left{k}", F.regexp_replace(f"q_left{k - 1}" if k else "q_text", CLASSES[name], ""))
    wanted = vocabulary()
    d = with_window_hashes(d, "q_words", window)
    # Every common word becomes one character; a histogram is then a few string lengths per document.
    codes = F.array(*[F.lit(w) for w in wanted])
    d = d.withColumn("q_found", F.filter("q_words", lambda w: F.lower(w).isin(wanted)))
    d = d.withColumn("q_codes", F.array_join(F.transform("q_found", lambda w: F.char(F.array_position(codes, F.lower(w)) + 32)), ""))
    left = [F.length("q_text"), *[F.length(f"q_left{k}") for k in range(len(names))]]
    classes = [a - b for a, b in zip(left, left[1:])] + [left[-1]]
    letters = F.array(*[F.lit(chr(33 + k)) for k in range(len(wanted))])
    common = F.transform(letters, lambda c: (F.length("q_codes") - F.length(F.replace(F.col("q_codes"), c, F.lit("")))).cast("long"))
    common = F.concat(common, F.array((F.size("q_words") - F.length("q_codes")).cast("long")))
    return d.select(
        *docs.columns,
        F.size("q_words").cast("long").alias("n_words"), F.length(F.array_join("q_words", "")).cast("long").alias("word_chars"),
        (F.length("q_text") - F.length(F.regexp_replace("q_text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words("q_hash", window).alias("n_repeat_words"),
        F.array(*[c.cast("long") for c in classes]).alias("q_classes"),
        common.alias("q_common"))


def references(measured: DataFrame, lang: str) -> DataFrame:
    """One row per language: the summed histograms, map-side first."""
    def sums(column: str, n: int) -> Column:
        return F.array(*[F.sum(F.col(column)[i]) for i in range(n)])
    return measured.groupBy(F.col(lang).alias("r_lang")).agg(
        sums("q_classes", len(CLASSES) + 1).alias("r_classes"), sums("q_common", len(vocabulary()) + 1).alias("r_common"))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two count arrays; null when either is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    share = lambda a: F.transform(F.array(F.struct(a.alias("a"), total(a).alias("t"))), lambda s: F.transform(s["a"], lambda x: F.try_divide(x, s["t"])))[0]
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    parts = F.zip_with(share(p), share(q), lambda x, y: (term(x, (x + y) / 2) + term(y, (x + y) / 2)) / 2)
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(total(parts), F.lit(0.0))))


def quality(docs: DataFrame, text: str = "text", lang: str = "lang", max_class: float = MAX_CLASS_DISTANCE,
            joint: tuple[float, float] = JOINT_DISTANCES, key: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per input row: ``key``, ``text_key``, the measures, both distances, ``base_failed``, ``kept``.

    The measures are written once; references come from the written table, so each text is read once.
    """
    d = docs.select(*key, F.col(text).alias("text"), F.col(lang).alias("lang"))
    m = materialize(measure(d).withColumn("text_key", text_key(F.col("text"))).drop("text"), "quality")
    # One row of about a kilobyte per language.
    ref = broadcast_if_small(materialize(references(m, "lang"), "references"), 20_000)
    out = m.join(ref, m["lang"].eqNullSafe(ref["r_lang"]), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(MAX_REPEAT_PERCENT) * F.col("n_words"))
    out = out.withColumn("class_distance", js_distance(F.col("q_classes"), F.col("r_classes"))) \
        .withColumn("word_distance", js_distance(F.col("q_common"), F.col("r_common"))).withColumn("base_failed", failed)
    far = ((F.col("word_chars") >= MIN_CHARS) & (F.col("class_distance") > max_class)) | \
        ((F.col("n_words") >= MIN_COMMON_WORDS) & (F.col("class_distance") > joint[0]) & (F.col("word_distance") > joint[1]))
    return out.select(*key, "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"), "class_distance", "word_distance")


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The rows that the rules keep, with all their columns. Rows are matched by id and text, so a
    repeated id with another text has its own verdict."""
    verdict = quality(docs, **options).where("kept").select(F.col("doc_id").alias("_v_id"), F.col("text_key").alias("_v_key")).distinct()
    on = docs["doc_id"].eqNullSafe(verdict["_v_id"]) & (text_key(docs["text"]) == verdict["_v_key"])
    return docs.join(verdict, on, "left_semi")
