"""Quality rules by distribution divergence, in DataFrame functions only.

Each document's histogram of character classes and its histogram of common words are compared
with the references of every language by Jensen-Shannon distance. The references are means over
all documents of a language. A document is judged by the language it is nearest to, and only
where it is long enough for its histogram to mean something. A document whose language has too few
documents for a reference is not judged by the references of others: only the base rules decide.
All features are made within the row; only the references are gathered.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WORD_BREAK, cut, table

# Frequent function words of each language, compared without regard to A-Z.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit ist des im dem nicht ein eine als auch es an".split(),
    "en": "the of and to in a is that for on was as with by it be are from at this".split(),
    "es": "de la que el en y a los se por del las un con una su para es al lo".split(),
    "fr": "de la le et les des en un que est du une dans au par pour sur qui pas plus".split(),
}
#: Documents with fewer words fail; the histograms are compared from these many words on.
MIN_WORDS, CHAR_GUARD, WORD_GUARD = 20, 20, 60
#: Largest share, in per cent, of words in repeated windows.
MAX_REPEAT = 30
WINDOW = 8
#: Marks around a word; white space, so that no word holds them.
OPEN, CLOSE = "\t", "\n"
#: Largest Jensen-Shannon distances (base 2, 0 to 1) from the nearest language, squared: a part for
#: any text and a part over the number of words, as short texts scatter more. They stand between the
#: 99th percentile of texts labelled good (0.15 for characters, 0.26 for words, at sf0.1) and the
#: median of those labelled bad (0.35, 0.33). The second pair is for texts that are far in both.
CHAR_LIMIT, WORD_LIMIT = (0.03, 2.5), (0.075, 1.0)
BOTH_LIMITS = (0.0155, 0.3), (0.055, 1.0)
#: Languages with fewer documents have no reference of their own.
MIN_REFERENCE = 20


def vocabulary(common: dict[str, Sequence[str]] | None = None) -> list[str]:
    return sorted({w for words in (common or COMMON_WORDS).values() for w in words})


def features(docs: DataFrame, text: str = "text", common: Sequence[str] | None = None) -> DataFrame:
    """Add the base counts, ``_chars`` and ``_common`` (histograms) to every row of ``docs``."""
    listed = list(common) if common is not None else vocabulary()
    add = docs.withColumn("_s0", F.coalesce(F.col(text), F.lit("")))
    # each step removes one class from what is left, so only the first reads the whole text
    for k, kind in enumerate([r"\p{Ll}+", r"\p{Lu}+", WORD_BREAK, r"\p{Nd}+", r"[#*$%&|<>]+"]):
        add = add.withColumn(f"_s{k + 1}", F.regexp_replace(f"_s{k}", kind, ""))
    sizes = [F.char_length(f"_s{k}").cast("long") for k in range(6)]
    add = add.withColumns({f"_n{k}": sizes[k] for k in range(6)})
    add = add.withColumn("_words", F.filter(F.split("_s0", WORD_BREAK), lambda w: w != ""))
    add = add.withColumn("_lines", F.filter(F.split("_s0", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("_words").cast("long")
    windows = F.transform(
        F.sequence(F.lit(0), F.size("_words") - WINDOW),
        lambda i: F.xxhash64(*[F.get("_words", i + k) for k in range(WINDOW)]),
    )
    add = add.withColumn("_windows", F.when(F.size("_words") > WINDOW, windows))
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    ordered = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    add = add.withColumn("_ordered", F.when(twice, ordered))
    same = lambda x, j: F.coalesce(x["h"] == F.get("_ordered", j - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get("_ordered", j + 1)["h"], F.lit(False))
    starts = F.array_sort(F.filter(F.transform("_ordered", lambda x, j: F.when(same(x, j), x["i"])), lambda i: i.isNotNull()))
    add = add.withColumn("_starts", starts)
    covered = F.aggregate(
        F.transform("_starts", lambda s, j: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", j + 1) - s, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda a, x: a + x,
    )
    fold = F.translate(F.col("_s0"), ascii_uppercase, ascii_lowercase)
    add = add.withColumn("_found", F.filter(F.split(fold, WORD_BREAK), lambda w: w.isin(listed)))
    # between marks that no word holds, a word's times are what its removal shortens the text by
    add = add.withColumn("_joined", F.concat(F.lit(OPEN), F.array_join("_found", CLOSE + OPEN), F.lit(CLOSE)))
    times = lambda word: ((F.octet_length("_joined") - F.octet_length(F.replace("_joined", F.lit(OPEN + word + CLOSE)))) / len((OPEN + word + CLOSE).encode())).cast("double")
    common_counts = F.array(*[times(c) for c in listed], (F.size("_words") - F.size("_found")).cast("double"))
    char_counts = F.array(*[(F.col(f"_n{k}") - F.col(f"_n{k + 1}")).cast("double") for k in range(5)], F.col("_n5").cast("double"))
    return add.select(
        *docs.columns,
        n.alias("n_words"),
        (F.col("_n0") - F.col("_n2") + F.col("_n3")).alias("word_chars"),
        (F.col("_n4") - F.col("_n5")).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        char_counts.alias("_chars"),
        common_counts.alias("_common"),
    )


def shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.try_divide(x, total))


def divergence(p: Column, q: Sequence[float]) -> Column:
    """Square of the base-2 Jensen-Shannon distance of two histograms of shares."""
    q_column = F.array(*[F.lit(float(x)) for x in q])
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(p, q_column, lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def references(found: DataFrame, lang: str = "lang", bins: int | None = None) -> dict[str, tuple[list[float], list[float]]]:
    """Mean histograms over all documents of each language that are long enough; rows without
    a language count as one more language. A few hundred numbers a language reach the driver."""
    bins = bins or len(vocabulary()) + 1
    usable = found.where(F.col("n_words") >= WORD_GUARD).select(
        F.coalesce(F.col(lang), F.lit("")).alias("l"), shares(F.col("_chars")).alias("c"), shares(F.col("_common")).alias("w")
    )
    means = usable.groupBy("l").agg(
        F.count("*").alias("n"),
        F.array(*[F.avg(F.get("c", F.lit(k))) for k in range(6)]).alias("c"),
        F.array(*[F.avg(F.get("w", F.lit(k))) for k in range(bins)]).alias("w"),
    ).where(F.col("n") >= MIN_REFERENCE)
    return {r["l"]: (list(r["c"]), list(r["w"])) for r in means.orderBy("l").collect()}


def judge(found: DataFrame, known: dict[str, tuple[list[float], list[float]]], lang: str) -> DataFrame:
    """Add char_distance, word_distance, base_failed and kept to rows that have ``features``.

    Rows of a language that is not ``known`` have no distances, and the base rules alone decide;
    rows without a language are judged by the nearest. With nothing ``known`` no row has distances.
    """
    compared = F.coalesce(F.col(lang), F.lit("")).isin("", *known) if known else F.lit(False)
    least = lambda column, at: F.least(*[divergence(column, ref[at]) for ref in known.values()], F.lit(1.0)) if known else F.lit(None).cast("double")
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    rows = found.withColumns({"_c": shares(F.col("_chars")), "_w": shares(F.col("_common"))})
    far = lambda column, guard, at: F.when(compared & (F.col("n_words") >= guard), F.sqrt(F.greatest(least(F.col(column), at), F.lit(0.0))))
    rows = rows.withColumns({
        "char_distance": far("_c", CHAR_GUARD, 0),
        "word_distance": far("_w", WORD_GUARD, 1),
        "base_failed": base_failed,
    })

    def beyond(distance: str, limit: tuple[float, float]) -> Column:
        return F.coalesce(F.pow(F.col(distance), 2) > limit[0] + F.try_divide(F.lit(limit[1]), F.col("n_words")), F.lit(False))

    both = beyond("char_distance", BOTH_LIMITS[0]) & beyond("word_distance", BOTH_LIMITS[1])
    odd = beyond("char_distance", CHAR_LIMIT) | beyond("word_distance", WORD_LIMIT) | both
    return rows.withColumn("kept", ~(F.col("base_failed") | odd)).drop("_c", "_w")


def verdicts(found: DataFrame) -> DataFrame:
    """``judge`` by the languages that have a reference; rows without a language give none."""
    known = references(found, "_lang")
    known.pop("", None)
    return judge(found, known, "_lang")


def quality(docs: DataFrame, keep: Sequence[str] = ("doc_id",), text: str = "text", lang: str = "lang") -> DataFrame:
    """The columns ``keep`` of every row with its base counts, distances and verdict.

    Null and empty texts have no words and fail. Texts of one endless word, only white space or
    only symbols are counted like any other, and texts of any length whole. Equal texts of one
    language are judged alike, repeated rows each for itself. An empty table gives an empty result.
    Columns of the input are read by name before any is added; only ``keep`` is carried along.
    """
    picked = docs.select(*keep, F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    found = cut(features(picked, "_text").drop("_text"), "quality")
    return verdicts(found).drop("_lang", "_chars", "_common")


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``; see ``quality`` for what passes.
    Rows with null or empty texts go, repeated rows stay together; an empty table stays empty."""
    named = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col(text).alias("_text"), F.col(lang).alias("_lang"))
    found = cut(features(named, "_text").drop("_text"), "quality-rows")
    return verdicts(found).where("kept").select("_row.*")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"),
    )


def sql() -> str:
    """The same by DuckDB, with windows compared as texts."""
    words = vocabulary()
    share = lambda name: f"list_transform({name}, lambda x: x / list_sum({name}))"
    mean = lambda name, n: "[" + ", ".join(f"avg({name}[{k}])" for k in range(1, n + 1)) + "]"
    term = lambda x, y: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({x} + {y}) / 2)) ELSE 0.0 END"
    far = lambda p, q: f"list_sum(list_transform(range(1, len({p}) + 1), lambda k: ({term(f'{p}[k]', f'{q}[k]')} + {term(f'{q}[k]', f'{p}[k]')}) / 2))"
    distance = lambda p, q: f"sqrt(greatest(least(coalesce(min({far(p, q)}), 1.0), 1.0), 0.0))"
    beyond = lambda name, limit: f"coalesce(pow({name}, 2) > {limit[0]} + {limit[1]} / nullif(n_words, 0), false)"
    return rf"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS s0 FROM documents
), s1 AS (SELECT *, regexp_replace(s0, '\p{{Ll}}+', '', 'g') AS s1 FROM texts
), s2 AS (SELECT *, regexp_replace(s1, '\p{{Lu}}+', '', 'g') AS s2 FROM s1
), s3 AS (SELECT *, regexp_replace(s2, '{WORD_BREAK}', '', 'g') AS s3 FROM s2
), s4 AS (SELECT *, regexp_replace(s3, '\p{{Nd}}+', '', 'g') AS s4 FROM s3
), s5 AS (SELECT *, regexp_replace(s4, '[#*$%&|<>]+', '', 'g') AS s5,
            list_filter(regexp_split_to_array(s0, '{WORD_BREAK}'), lambda w: w <> '') AS words,
            list_filter(regexp_split_to_array(translate(s0, '{ascii_uppercase}', '{ascii_lowercase}'), '{WORD_BREAK}'), lambda w: w IN ({", ".join(f"'{w}'" for w in words)})) AS listed,
            list_filter(string_split(s0, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM s4
), win AS (
  SELECT rid, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS w FROM (SELECT rid, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM s5 WHERE len(words) >= {WINDOW})
), twice AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, w) AS c FROM win) WHERE c > 1
), covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(0, {WINDOW}) r(k) GROUP BY rid
), found AS (
  SELECT s5.rid, doc_id, lang, len(words) AS n_words, length(s0) - length(s2) + length(s3) AS word_chars, length(s4) - length(s5) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
         [length(s0) - length(s1), length(s1) - length(s2), length(s2) - length(s3), length(s3) - length(s4), length(s4) - length(s5), length(s5)]::DOUBLE[] AS chars,
         [{", ".join(f"len(list_filter(listed, lambda w: w = '{w}'))" for w in words)}, len(words) - len(listed)]::DOUBLE[] AS common
  FROM s5 LEFT JOIN covered ON covered.rid = s5.rid
), shared AS (SELECT *, {share('chars')} AS c, {share('common')} AS w FROM found
), refs AS (SELECT lang, {mean('c', 6)} AS rc, {mean('w', len(words) + 1)} AS rw FROM shared WHERE n_words >= {WORD_GUARD} AND lang <> '' GROUP BY lang HAVING count(*) >= {MIN_REFERENCE}
), far AS (SELECT s.rid, {distance('c', 'rc')} AS cd, {distance('w', 'rw')} AS wd FROM shared s CROSS JOIN refs WHERE s.lang = '' OR s.lang IN (SELECT lang FROM refs) GROUP BY s.rid
), judged AS (
  SELECT shared.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed,
         CASE WHEN n_words >= {CHAR_GUARD} THEN cd END AS cd, CASE WHEN n_words >= {WORD_GUARD} THEN wd END AS wd
  FROM shared LEFT JOIN far ON far.rid = shared.rid
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR {beyond('cd', CHAR_LIMIT)} OR {beyond('wd', WORD_LIMIT)} OR ({beyond('cd', BOTH_LIMITS[0])} AND {beyond('wd', BOTH_LIMITS[1])})) AS kept,
       round(cd, 6) AS char_distance, round(wd, 6) AS word_distance
FROM judged
"""


QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLES = {"op5_quality_rules": sql()}
