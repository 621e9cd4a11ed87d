"""Quality rules by distribution divergence, DataFrame functions only.

A document is described by two histograms: its character classes and its
common words.  Language references are the mean histograms of all documents of
a language; a document is compared with every reference by Jensen-Shannon
distance (base 2, in 0..1) and judged by its nearest one, so a missing or wrong
language label does not decide.  Short documents are guarded: below
``min_chars`` / ``min_words`` a histogram is too thin and its distance is not
used.  A document is rejected when its characters are far from every language, or
when characters and words both are fairly far.  Fixed length and repetition rules come first.

Defined edge results: a null or blank text has no words and fails the length
rule; without any labelled document there is no reference and the divergence
rule passes; repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airwell.llm._common import WHITE, materialize, text_of

# Frequent function words of the supported languages.
COMMON_WORDS = {
    "en": ["the", "of", "to", "and", "in", "is", "for", "that", "was", "on", "with", "are", "you", "it", "at"],
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht"],
    "fr": ["le", "la", "les", "des", "et", "un", "une", "du", "est", "que", "dans", "pour", "qui", "par", "elle"],
    "es": ["el", "los", "las", "se", "del", "por", "con", "una", "su", "para", "lo", "como", "más", "al", "no"],
}
SYMBOLS = "#*$%&|<>"

MIN_WORDS = 50              # fixed rule: fewer words fail
MAX_REPEAT_PERCENT = 50     # fixed rule: more repeated words fail
GUARD_CHARS = 200           # below this no character-class verdict
GUARD_WORDS = 80            # below this no common-word verdict
MAX_CHAR_JSD = 0.28         # alone enough to reject
BOTH_CHAR_JSD = 0.15        # both of these together reject
BOTH_WORD_JSD = 0.235


def _common_list() -> list[str]:
    return list(dict.fromkeys(w for ws in COMMON_WORDS.values() for w in ws))


def _count_of(text: Column, piece: str) -> Column:
    """Occurrences of a fixed string, by length difference."""
    return F.try_divide(F.octet_length(text) - F.octet_length(F.replace(text, F.lit(piece), F.lit(""))),
                        F.lit(len(piece.encode()))).cast("long")


def _word_columns(docs: DataFrame, doc_id: str, text: str, lang: str | None) -> DataFrame:
    """doc_id, hash of the text, label, words and the counts of the fixed rules."""
    language = F.col(lang).cast("string") if lang else F.lit(None).cast("string")
    t = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("t"), language.alias("lang"))
    t = t.withColumn("w", F.array_remove(F.split("t", WHITE), ""))
    # what is neither a small ASCII letter nor white space: a short string for the class counts
    return t.select(
        "doc_id", "lang", "w", F.xxhash64("t").alias("text_key"),
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length("t").cast("long").alias("n_chars"),
        F.regexp_replace("t", r"[a-z\x20\x09-\x0D]+", "").alias("rest"),
        F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0).alias("lines"))


def _repeat_words(t: DataFrame) -> DataFrame:
    """Words in 3-word windows that occur twice or more in the row.

    A window becomes one long: the high bits of its hash over the bits of its
    position (as many as the row needs), so one primitive sort brings equal
    windows together with their places.  The words of neighbours with equal hash
    bits are compared; where they differ, the windows found in the row are
    ordered by their words instead.
    """
    bits = F.ceil(F.log2(F.col("n_words") + F.lit(2))).cast("int")
    t = t.withColumn("k", bits)
    low = F.expr("shiftleft(1L, k) - 1L")
    windows = F.when(F.col("n_words") >= 3, F.transform(
        F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")),
        lambda i: F.xxhash64(F.col("w")[i], F.col("w")[i + 1], F.col("w")[i + 2])
        .bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))).otherwise(F.array().cast("array<bigint>"))
    t = t.withColumn("s", F.sort_array(windows))
    # of two equal neighbours both places are hits
    same = F.expr("filter(transform(sequence(0, size(s) - 2), i -> "
                  "if(shiftright(s[i] ^ s[i + 1], k) = 0, i, -1)), x -> x >= 0)")
    t = t.withColumn("e", F.when(F.size("s") >= 2, same).otherwise(F.array().cast("array<int>")))
    t = t.withColumn("p", F.expr(
        "sort_array(transform(array_union(e, transform(e, x -> x + 1)), x -> s[x] & (shiftleft(1L, k) - 1L)))"))
    place = "cast(s[x{}] & (shiftleft(1L, k) - 1L) as int)"
    differs = " or ".join(f"w[{place.format('')} + {j}] != w[{place.format(' + 1')} + {j}]" for j in range(3))
    by_words = F.expr("array_sort(transform(p, i -> struct(concat_ws(' ', slice(w, cast(i as int) + 1, 3)) as v, i as i)))")
    t = t.withColumn("c", F.when(F.expr(f"exists(e, x -> {differs})"), by_words))
    t = t.withColumn("p", F.when(F.col("c").isNull(), F.col("p")).otherwise(F.expr(
        "sort_array(transform(filter(c, (x, j) -> (j > 0 and get(c, j - 1).v = x.v) or (get(c, j + 1).v <=> x.v)), x -> x.i))")))
    covered = F.expr("aggregate(zip_with(slice(p, 1, size(p) - 1), slice(p, 2, size(p) - 1), "
                     "(a, b) -> least(b - a, 3L)), 3L, (x, y) -> x + y)")
    return t.withColumn("n_repeat_words", F.when(F.size("p") > 0, covered).otherwise(F.lit(0)).cast("long")) \
        .drop("k", "s", "e", "p", "c")


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """Per row: doc_id, text_key, lang, the counts of the fixed rules and the two
    histograms ``chars`` and ``common`` (arrays of counts)."""
    t = _repeat_words(_word_columns(docs, doc_id, text, lang))
    words = _common_list()
    forms = [f for w in words for f in (w, w.capitalize())]
    inside = F.lower(F.array_join(F.filter("w", lambda x: x.isin(forms)), "  "))
    t = t.withColumn("cw", F.concat(F.lit(" "), inside, F.lit(" ")))
    n = {name: F.regexp_count("rest", F.lit(rule)).cast("long")
         for name, rule in (("symbol", r"[#*$%&|<>]"), ("upper", "[A-Z]"), ("digit", "[0-9]"), ("point", r"[.,;:!?'()\"-]"))}
    for name, c in n.items():
        t = t.withColumn(f"n_{name}", c)
    rest = F.length("rest").cast("long")
    other = rest - F.col("n_symbol") - F.col("n_upper") - F.col("n_digit") - F.col("n_point")
    lower = F.col("word_chars") - rest
    return t.select(
        "doc_id", "text_key", "lang", "n_words", "word_chars", F.col("n_symbol").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words", "n_chars",
        F.array(lower, F.col("n_upper"), F.col("n_digit"), F.col("n_point"), F.col("n_symbol"), other,
                F.col("n_chars") - F.col("word_chars")).alias("chars"),
        F.array(*[_count_of(F.col("cw"), f" {w} ") for w in words]).alias("common"))


def references(feat: DataFrame) -> DataFrame:
    """Mean histograms per language with a common-word list, over all labelled rows: one row per language."""
    labelled = feat.filter(F.col("lang").isin(list(COMMON_WORDS)))
    n_chars, n_words = 7, len(_common_list())
    share = lambda c, i, total: F.sum(F.col(c)[i] / F.greatest(total, F.lit(1)))
    return labelled.groupBy("lang").agg(
        F.array(*[share("chars", i, F.col("n_chars")) for i in range(n_chars)]).alias("ref_chars"),
        F.array(*[share("common", i, F.col("n_words")) for i in range(n_words)]).alias("ref_common"),
        F.count("*").alias("n_ref"))


def _plogp(a: Column) -> Column:
    return F.when(a > 0, a * F.log2(a)).otherwise(F.lit(0.0))


def _unit(c: str, total: str) -> Column:
    return F.transform(F.col(c), lambda v: v / F.greatest(F.col(total), F.lit(1e-12)))


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def _jsd(p: str, own: str, q: list[float]) -> Column:
    """Jensen-Shannon distance (square root of the base-2 divergence) of the unit
    array ``p`` and a reference: entropy of the mean less the mean entropy;
    column ``own`` is the sum of p log p."""
    ref = F.array(*[F.lit(float(x)) for x in q])
    ref_own = sum(x * math.log2(x) for x in q if x > 0)
    mean = _total(F.zip_with(F.col(p), ref, lambda a, b: _plogp((a + b) / 2)))
    return F.sqrt(F.greatest((F.col(own) + F.lit(ref_own)) / 2 - mean, F.lit(0.0)))


def reference_vectors(feat: DataFrame) -> list[tuple[list[float], list[float]]]:
    """The references as plain vectors: at most one pair per listed language (four), whatever the corpus."""
    out = []
    for r in references(feat).orderBy("lang").collect():
        chars = [x / r["n_ref"] for x in r["ref_chars"]]
        common = [x / r["n_ref"] for x in r["ref_common"]]
        out.append((chars, [*common, max(0.0, 1.0 - sum(common))]))
    return out


def judge(feat: DataFrame, refs: list | None = None, max_char_jsd: float = MAX_CHAR_JSD,
          both_char_jsd: float = BOTH_CHAR_JSD, both_word_jsd: float = BOTH_WORD_JSD,
          guard_chars: int = GUARD_CHARS, guard_words: int = GUARD_WORDS) -> DataFrame:
    """Verdict per feature row: base_failed, char_jsd, word_jsd (distance to the
    nearest reference, null when the guard holds or no reference exists), kept."""
    refs = reference_vectors(feat) if refs is None else refs
    unit = lambda xs: [x / max(sum(xs), 1e-12) for x in xs]
    doubles = lambda c: F.transform(F.col(c), lambda v: v.cast("double"))
    t = feat.withColumn("__p", doubles("chars")).withColumn("__c", doubles("common"))
    t = t.withColumn("__c", F.concat("__c", F.array(F.greatest(F.col("n_words") - _total(F.col("__c")), F.lit(0.0)))))
    t = t.withColumn("__pt", _total(F.col("__p"))).withColumn("__ct", _total(F.col("__c")))
    t = t.withColumn("__p", _unit("__p", "__pt")).withColumn("__c", _unit("__c", "__ct"))
    t = t.withColumn("__po", _total(F.transform("__p", _plogp))).withColumn("__co", _total(F.transform("__c", _plogp)))

    def nearest(p: str, own: str, vectors: list) -> Column:
        if not vectors:
            return F.lit(None).cast("double")
        return F.array_min(F.array(*[_jsd(p, own, v) for v in vectors]))

    t = t.withColumn("char_jsd", F.when(F.col("n_chars") >= guard_chars, nearest("__p", "__po", [unit(c) for c, _ in refs])))
    t = t.withColumn("word_jsd", F.when(F.col("n_words") >= guard_words, nearest("__c", "__co", [unit(w) for _, w in refs])))
    t = t.withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                     | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    char_jsd, word_jsd = F.coalesce("char_jsd", F.lit(0.0)), F.coalesce("word_jsd", F.lit(0.0))
    far = (char_jsd > max_char_jsd) | ((char_jsd > both_char_jsd) & (word_jsd > both_word_jsd))
    return t.withColumn("kept", ~F.col("base_failed") & ~far).drop("__p", "__c", "__pt", "__ct", "__po", "__co")


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang", **limits) -> DataFrame:
    """Counts, distances and verdict of every row of ``docs``.

    The histograms are written once: the references are a full pass over them
    and the verdict is the next, so texts are read a single time."""
    return judge(materialize(features(docs, doc_id, text, lang), "quality-features"), **limits)


def filter_documents(docs: DataFrame, **names) -> DataFrame:
    """``docs`` without the rejected rows; all columns stay as they are."""
    bad = score(docs, **names).filter(~F.col("kept"))
    bad = bad.select(F.col("doc_id").alias("__llm_id"), F.col("text_key").alias("__llm_key")).distinct()
    doc_id, text = names.get("doc_id", "doc_id"), names.get("text", "text")
    return docs.join(bad, docs[doc_id].eqNullSafe(bad["__llm_id"])
                     & (F.xxhash64(F.coalesce(docs[text].cast("string"), F.lit(""))) == bad["__llm_key"]), "left_anti")
