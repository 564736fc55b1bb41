"""Document fingerprints by spot signatures, in DataFrame functions only.

Common words are anchors: where content words follow an anchor, the anchor and the next content
words (common words between them left out) form a signature, and so do the first content words of a
text. A document's fingerprint is the set of its signatures' digests. Sets are compared by Jaccard
likeness with pruning: the ratio of two sets' lengths bounds it, so near matches are searched only
within partitions of neighbouring lengths, by each set's rarest signatures, and verified.
"""

from __future__ import annotations

import math
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, table

# Frequent function words of each language; A-Z are lower-cased before they are compared.
ANCHORS = {
    "de": "der die und in den von zu das mit ist des im dem nicht ein eine als auch es an".split(),
    "en": "the of and to in a is that for on was as with by it be are from at this".split(),
    "es": "de la que el en y a los se por del las un con una su para es al lo".split(),
    "fr": "de la le et les des en un que est du une dans au par pour sur qui pas plus".split(),
}
#: Content words of a chain, hex digits of a signature's digest, what the first chain has as anchor.
CHAIN, DIGITS, START = 2, 12, "^"
#: What separates words: ASCII white space and punctuation.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Least likeness of near matches.
LIKENESS = 0.8
#: Documents of one range of ids, which meet in one task.
NEIGHBOURS = 256


def anchors(listed: dict[str, list[str]] | None = None) -> list[str]:
    return sorted({w for words in (listed or ANCHORS).values() for w in words})


def let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` evaluated once a row however often ``body`` names it."""
    return F.transform(F.array(value), body).getItem(0)


def signatures(text: Column, common: list[str] | None = None, chain: int = CHAIN) -> Column:
    """Sorted different digests of a text's signatures.

    Null, empty and texts without a word have none; a text of common words alone has one, of all its
    words. Chains at the end of the text may be shorter. Of anchors in a row only the last counts.
    """
    listed = common if common is not None else anchors()
    words = F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase), BREAK), lambda w: w != "")
    tagged = lambda ws: F.transform(ws, lambda w, i: F.struct(w.alias("w"), F.when(i == 0, F.lit(START)).otherwise(F.get(ws, i - 1)).alias("before")))
    content = lambda ws: F.filter(tagged(ws), lambda x: ~x["w"].isin(listed))
    following = lambda cs: F.filter(
        F.transform(cs, lambda c, j: F.when((j == 0) | c["before"].isin(listed), F.concat_ws(" ", F.when(c["before"].isin(listed), c["before"]).otherwise(F.lit(START)), c["w"], *[F.get(cs, j + k)["w"] for k in range(1, chain)]))),
        lambda s: s.isNotNull(),
    )
    chains = lambda ws: let(content(ws), lambda cs: F.when(F.size(cs) > 0, following(cs)).when(F.size(ws) > 0, F.array(F.array_join(ws, " "))).otherwise(F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.transform(let(words, chains), lambda s: F.substring(F.md5(s.cast("binary")), 1, DIGITS))))


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard likeness of two sets, null only where a set is null; 1 for two empty ones. Where the
    ratio of the lengths stays below ``least``, the likeness cannot reach it and is given as 0 unseen."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    same = F.size(F.array_intersect(a, b))
    met = F.when(a == b, 1.0).when((small == 0) | (small < F.lit(least) * large), 0.0).otherwise(let(same, lambda n: n / (small + large - n)))
    return F.when(a.isNotNull() & b.isNotNull(), met)


def fingerprint(found: Column) -> Column:
    """A set of signatures as one string."""
    return F.array_join(found, "")


def beside_next(docs: DataFrame, id_column: str, columns: list[str], name) -> DataFrame:
    """Every row with ``columns`` of the row that follows in descending id (after the last: the first),
    named ``name(column)``. Rows of one id follow each other by their columns; null ids come last.

    Ids are dealt by ranges of about NEIGHBOURS ids, so rows move once. Only a range's first row goes
    to another range, the one before it, whose last row it follows."""
    key = F.col(id_column).cast("long")
    about = docs.agg(F.min(key), F.max(key), F.count(key)).first()
    spread = (int(about[1]) - int(about[0]) + 1) // about[2] if about[2] else 1
    bits = (NEIGHBOURS - 1).bit_length() + max(1, spread).bit_length() - 1
    if spread > 1 and docs.groupBy(F.shiftright(key, bits)).count().agg(F.max("count")).first()[0] > 16 * NEIGHBOURS:
        bits = (NEIGHBOURS - 1).bit_length()  # unevenly spread: no range has more ids than this, but some have few
    ranged = docs.select(id_column, *columns, F.coalesce(F.shiftright(key, bits), F.lit(-(2**63))).alias("_range"))
    dealt = ranged.repartition("_range")
    order = Window.partitionBy("_range").orderBy(key.desc_nulls_last(), *columns)
    within = dealt.select("*", *[F.lead(c).over(order).alias(f"_next_{k}") for k, c in enumerate(columns)], F.lead(F.lit(True)).over(order).alias("_has"), F.row_number().over(order).alias("_at"))
    ranges = cut(ranged.select("_range").distinct().repartitionByRange(F.col("_range").desc()).sortWithinPartitions(F.col("_range").desc()).withColumn("_part", F.spark_partition_id()), "ranges")
    # a range's predecessor: within its part, or the last of the part before; the first follows the last
    ends = ranges.groupBy("_part").agg(F.min("_range").alias("_last"))
    one = Window.partitionBy(F.lit(0)).orderBy("_part")
    everywhere = one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = ends.select("_part", F.coalesce(F.lag("_last").over(one), F.last("_last").over(everywhere)).alias("_above"))
    inside = Window.partitionBy("_part").orderBy(F.col("_range").desc())
    linked = ranges.join(before, "_part").select(F.col("_range").alias("_own"), F.coalesce(F.lag("_range").over(inside), F.col("_above")).alias("_to"))
    heads = within.where("_at = 1").join(linked, F.col("_range") == F.col("_own")).select(F.col("_to").alias("_range"), *[F.col(c).alias(f"_head_{k}") for k, c in enumerate(columns)])
    return within.join(heads, "_range").select(
        id_column, *columns, *[F.when(F.col("_has"), F.col(f"_next_{k}")).otherwise(F.col(f"_head_{k}")).alias(name(c)) for k, c in enumerate(columns)]
    )


def near_matches(queries: DataFrame, docs: DataFrame, least: float = LIKENESS, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(query, doc, likeness) for every row of ``queries`` and every row of ``docs`` whose fingerprints'
    likeness is ``least`` or more. Exact: no pair is lost.

    Equal fingerprints meet once. Sets are partitioned by length so that only neighbouring partitions
    can match. There a set is found by any of its rarest signatures: a match shares one of them.
    Texts without a word match each other. Repeated rows and ids keep their rows; null ids match as
    any other; empty tables give an empty result; other columns are not read.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    sets = lambda rows: rows.select(F.col(id_column), signatures(F.col(text)).alias("s")).select(id_column, "s", fingerprint(F.col("s")).alias("f"))
    asked, there = cut(sets(queries), "asked"), cut(sets(docs), "spots")
    rare = there.dropDuplicates(["f"]).select(F.explode("s").alias("x")).groupBy("x").count().withColumnRenamed("count", "n")
    width = -math.log(min(least, 0.999)) * (1 + 1e-7)  # sets whose lengths' ratio is ``least`` or more are one band apart at most
    band = F.floor(F.log(F.size("s").cast("double")) / width).cast("int")

    def keyed(rows: DataFrame) -> DataFrame:
        """Different sets with their rarest signatures: all but the (least x length) most frequent, and one."""
        sized = rows.dropDuplicates(["f"]).where(F.size("s") > 0).select("f", "s", band.alias("band"))
        ranked = sized.select("f", F.explode("s").alias("x")).join(rare, "x", "left").groupBy("f").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "x"))).alias("o"))
        first = F.slice("o", F.lit(1), F.size("o") - F.ceil(F.lit(least - 1e-9) * F.size("o")).cast("int") + 1)
        return sized.join(ranked, "f").select("f", "s", "band", F.explode(F.transform(first, lambda y: y["x"])).alias("x"))

    left = keyed(asked).select(F.col("f").alias("q"), F.col("s").alias("qs"), F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), "x")
    met = left.join(keyed(there), ["band", "x"]).where(F.least(F.size("qs"), F.size("s")) >= F.lit(least - 1e-9) * F.greatest(F.size("qs"), F.size("s")))
    pairs = met.dropDuplicates(["q", "f"]).select("q", "f", likeness(F.col("qs"), F.col("s"), least - 1e-9).alias("likeness")).where(F.col("likeness") >= least)
    empty = asked.where("f = ''").select(F.col("f").alias("q"), "f", F.lit(1.0).alias("likeness")).distinct()
    named = asked.select(F.col(id_column).alias("query"), F.col("f").alias("q")).join(pairs.union(empty), "q")
    return named.join(there.select(F.col(id_column).alias("doc"), "f"), "f").select("query", "doc", "likeness")


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every
    document. The edited text has its last half replaced by as many first code points of the next
    document in descending id; near_edited and near_next are the fingerprint's likeness to the edited
    text's and to the next document's.

    Null texts count as empty. Empty texts and texts without a word have an empty fingerprint, which is
    like another empty one. Equal texts have equal fingerprints. A single document follows itself.
    Rows of one id follow each other by their text, null ids come last. Texts of any length are taken
    whole. Other columns are not read. An empty table gives an empty result.
    """
    own = docs.select(id_column, F.coalesce(text, F.lit("")).alias("_text"))
    pairs = beside_next(own, id_column, ["_text"], lambda c: "_after")
    half = F.floor(F.char_length("_text") / 2).cast("int")
    edited = F.concat(F.expr("left(_text, char_length(_text) - cast(floor(char_length(_text) / 2) as int))"), F.substring("_after", F.lit(1), half))
    made = pairs.select(id_column, F.char_length("_text").cast("long").alias("n_chars"), "_text", "_after", edited.alias("_edited"))
    spots = made.select(
        id_column, "n_chars", F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"),
        signatures(F.col("_text")).alias("_own"), signatures(F.col("_edited")).alias("_new"), signatures(F.col("_after")).alias("_other"),
    )
    return spots.select(
        id_column, "n_chars", "edited_sha256", fingerprint(F.col("_own")).alias("fingerprint"), fingerprint(F.col("_new")).alias("edited_fingerprint"),
        likeness(F.col("_own"), F.col("_new")).alias("near_edited"), likeness(F.col("_own"), F.col("_other")).alias("near_next"),
    )


def op12_document_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


_SPOTS = """
  list_sort(list_distinct(list_transform(CASE
    WHEN len(c{0}) > 0 THEN list_filter(list_transform(range(1, len(c{0}) + 1), lambda j: CASE WHEN j = 1 OR list_contains(common, c{0}[j].b) THEN
      (CASE WHEN list_contains(common, c{0}[j].b) THEN c{0}[j].b ELSE '^' END) || ' ' || c{0}[j].w || coalesce(' ' || c{0}[j + 1].w, '') END), lambda s: s IS NOT NULL)
    WHEN len(w{0}) > 0 THEN [array_to_string(w{0}, ' ')] ELSE [] END, lambda s: md5(s)[1:12]))) AS s{0}"""
_WORDS = """
  list_filter(regexp_split_to_array(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w{1}"""
_CONTENT = """
  list_filter(list_transform(range(1, len(w{0}) + 1), lambda i: {{'w': w{0}[i], 'b': CASE WHEN i = 1 THEN '^' ELSE w{0}[i - 1] END}}), lambda x: NOT list_contains(common, x.w)) AS c{0}"""
_LIKE = "CASE WHEN s1 = s{0} THEN 1.0::DOUBLE WHEN len(s1) = 0 OR len(s{0}) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(s1, s{0}))::DOUBLE / (len(s1) + len(s{0}) - len(list_intersect(s1, s{0}))) END"
SQL = (
    "WITH own AS (SELECT doc_id, coalesce(text, '') AS t1 FROM documents), ordered AS ("
    " SELECT doc_id, t1, coalesce(lead(t1) OVER (ORDER BY doc_id DESC), first_value(t1) OVER (ORDER BY doc_id DESC)) AS t3 FROM own), made AS ("
    " SELECT *, substr(t1, 1, length(t1) - length(t1) // 2) || substr(t3, 1, length(t1) // 2) AS t2, ["
    + ", ".join(f"'{w}'" for w in anchors()) + "] AS common FROM ordered), worded AS (SELECT *, " + ", ".join(_WORDS.format(f"t{k}", k) for k in (1, 2, 3))
    + " FROM made), kept AS (SELECT *, " + ", ".join(_CONTENT.format(k) for k in (1, 2, 3)) + " FROM worded), spots AS (SELECT *, " + ", ".join(_SPOTS.format(k) for k in (1, 2, 3))
    + " FROM kept) SELECT doc_id, length(t1) AS n_chars, sha256(t2) AS edited_sha256, array_to_string(s1, '') AS fingerprint, array_to_string(s2, '') AS edited_fingerprint, "
    + _LIKE.format(2) + " AS near_edited, " + _LIKE.format(3) + " AS near_next FROM spots"
)

QUERIES = {"op12_document_fingerprint": op12_document_fingerprint}
ORACLES = {"op12_document_fingerprint": SQL}
