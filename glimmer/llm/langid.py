"""Language identification by interpolated Kneser-Ney character models.

One model per language, learned from a bounded sample of labelled rows. All models live in one
sorted array of n-gram hashes per order, with a column of probabilities per language, and one
sorted array of contexts with the weight that each language gives to the next lower order. A
text's cross-entropy is summed over its words (contexts start anew at each word), so each
distinct word of a batch is scored once. The language with the least cross-entropy a character
wins; texts beyond a limit that labelled texts calibrate are rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import in_fold, number_words, slices, table

ORDER = 5
#: About so many labelled rows of each language are learned from (four fifths of a smaller table),
#: and at most as many others calibrate the limit beyond which a text is rejected.
SAMPLE_ROWS = 400
#: A text is rejected beyond so many times the cross-entropy that all but a hundredth of the
#: calibrating texts of its language stay below. A language with fewer than MIN_CALIBRATION of them
#: takes the limit of all languages.
REJECT_MARGIN, CALIBRATED_SHARE, MIN_CALIBRATION = 1.8, 0.99, 30
#: Characters beyond which more evidence does not make the score steeper.
EVIDENCE_CHARS = 40
UNKNOWN = "und"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def spell(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, each after ORDER-1 spaces and before one; and which of them are predicted."""
    pad = " " * (ORDER - 1)
    line = "".join([f"{pad}{w} " for w in words])
    codes = np.frombuffer(line.encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    word_of = np.repeat(np.arange(len(words)), sizes)
    first = np.cumsum(sizes + ORDER - 1) - sizes
    at = np.arange(len(word_of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + first[word_of]
    return codes, at


def mixed(rolled: np.ndarray, order: int) -> np.ndarray:
    x = rolled ^ np.uint64(order * 0x5851F42D4C957F2D & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(codes: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Hashes of the grams of order 0, 1, ... that end at ``at``."""
    rolled, power, out = np.zeros(len(at), np.uint64), np.uint64(1), [np.zeros(len(at), np.uint64)]
    with np.errstate(over="ignore"):
        for k in range(ORDER):
            rolled = rolled + (codes[at - k] + np.uint64(1)) * power
            power = power * _STEP
            out.append(mixed(rolled, k + 1))
    return out


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in sorted ``keys``, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


@dataclass
class Models:
    languages: list[str]
    grams: list[np.ndarray]  # by order: sorted hashes
    chance: list[np.ndarray]  # by order: (gram, language) interpolated probability
    contexts: list[np.ndarray]  # by order of the gram: sorted hashes of its context
    back: list[np.ndarray]  # by order: (context, language) weight of the lower order
    floor: float
    limits: np.ndarray | None = None  # by language: largest cross-entropy that is accepted; None: any

    def accepted(self, languages: list[str], entropy: np.ndarray) -> np.ndarray:
        """Whether each text, of the language and cross-entropy found, is accepted; none without a letter."""
        if self.limits is None or not len(self.limits):
            return entropy < np.inf
        limit = dict(zip(self.languages, self.limits, strict=True))
        return entropy <= np.array([limit.get(x, 0.0) for x in languages], float)

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word, language) natural log-probabilities and characters predicted, for distinct words."""
        codes, at = spell(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        hashes = gram_hashes(codes, at)
        before = gram_hashes(codes, at - 1)
        logs = np.zeros((len(at), len(self.languages)), np.float32)
        open_ = np.arange(len(at))
        for k in range(ORDER, 0, -1):
            place, hit = find(self.grams[k], hashes[k][open_])
            logs[open_[hit]] += np.log(self.chance[k][place[hit]])
            open_ = open_[~hit]
            place, hit = find(self.contexts[k], before[k - 1][open_])
            logs[open_[hit]] += np.log(self.back[k][place[hit]])
        logs[open_] += np.log(self.floor)
        return np.add.reduceat(logs, np.cumsum(sizes) - sizes, axis=0, dtype=np.float64) if len(words) else logs.astype(float), sizes

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and cross-entropy a character of each text; UNKNOWN, 0 and NaN without a letter."""
        ids, ends, distinct = number_words([t.lower() if t else t for t in texts])
        words = [w.decode() for w in distinct]
        lettered = np.fromiter((any(map(str.isalpha, w)) for w in words), bool, len(words))
        scores, sizes = np.zeros((len(words), len(self.languages))), np.zeros(len(words), np.int64)
        chosen = np.flatnonzero(lettered)
        for i in range(0, len(chosen), 50_000):
            some = chosen[i : i + 50_000]
            scores[some], sizes[some] = self.word_scores([words[j] for j in some])
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        total = np.zeros((len(texts), len(self.languages)))
        chars = np.zeros(len(texts), np.int64)
        for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
            total[i], chars[i] = scores[ids[a:b]].sum(0), sizes[ids[a:b]].sum()
        entropy = np.full(total.shape, np.nan)
        has = (chars > 0) & (len(self.languages) > 0)
        entropy[has] = -total[has] / chars[has, None]
        best = np.where(has, np.argmin(np.where(np.isnan(entropy), np.inf, entropy), 1) if len(self.languages) else 0, -1)
        least = np.full(len(texts), np.nan)
        sure = np.zeros(len(texts))
        for i in np.flatnonzero(has):
            least[i] = entropy[i, best[i]]
            sure[i] = 1 / np.exp(-(entropy[i] - least[i]) * min(chars[i], EVIDENCE_CHARS)).sum()
        return [self.languages[b] if b >= 0 else UNKNOWN for b in best], sure, least


def build(counts: dict[str, dict[str, int]]) -> Models:
    """Models from word counts by language."""
    languages = sorted(counts)
    if not languages:
        return Models([], [np.zeros(0, np.uint64)] * (ORDER + 1), [np.zeros((0, 0))] * (ORDER + 1), [np.zeros(0, np.uint64)] * (ORDER + 1), [np.zeros((0, 0))] * (ORDER + 1), 1.0)
    grams, chance, contexts, back = [[np.zeros(0, np.uint64)] for _ in range(4)]
    own: list[dict] = []
    alphabet: set[str] = {" "}
    for language in languages:
        words = sorted(counts[language])
        alphabet.update(*words)
        codes, at = spell(words)
        times = np.repeat([counts[language][w] for w in words], [len(w) + 1 for w in words])
        here, before = gram_hashes(codes, at), gram_hashes(codes, at - 1)
        orders = {}
        for k in range(ORDER, 0, -1):
            keys, where, inverse = np.unique(here[k], return_index=True, return_inverse=True)
            raw = np.bincount(inverse, times, len(keys))
            if k == ORDER:
                n = raw
            else:  # in how many different longer grams it ends
                longer = orders[k + 1]
                n = np.bincount(np.searchsorted(keys, longer["lower"]), minlength=len(keys)).astype(float)
            orders[k] = {"keys": keys, "n": n, "context": before[k - 1][where], "lower": here[k - 1][where]}
        own.append(orders)
    floor = 1 / (len(alphabet) + 1)
    for k in range(1, ORDER + 1):
        keys, first = np.unique(np.concatenate([o[k]["keys"] for o in own]), return_index=True)
        context = np.concatenate([o[k]["context"] for o in own])[first]
        lower = np.concatenate([o[k]["lower"] for o in own])[first]
        known = np.unique(context)
        at = np.searchsorted(known, context)
        p, b = np.zeros((len(keys), len(languages))), np.ones((len(known), len(languages)))
        below = np.full((len(keys), len(languages)), floor) if k == 1 else chance[k - 1][np.searchsorted(grams[k - 1], lower)]
        for j, o in enumerate(own):
            n = o[k]["n"]
            once, twice = (n == 1).sum(), (n == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            place = np.searchsorted(known, o[k]["context"])
            total = np.bincount(place, n, len(known))
            kinds = np.bincount(place, minlength=len(known))
            seen = total > 0
            b[seen, j] = discount * kinds[seen] / total[seen]
            mine = np.searchsorted(keys, o[k]["keys"])
            p[mine, j] = np.maximum(n - discount, 0) / total[place]
        p += b[at] * below
        grams.append(keys)
        chance.append(p.astype(np.float32))
        contexts.append(known)
        back.append(b.astype(np.float32))
    return Models(languages, grams, chance, contexts, back, floor)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", id_column: str = "doc_id", rows: int = SAMPLE_ROWS) -> Models:
    """Learn from about ``rows`` rows of each language and calibrate on as many others.

    Rows are taken by a hash of their id, at a rate that follows the language's count, so nothing
    is sorted and the sample spreads over the whole table. Rows without text or language teach
    nothing. Without any labelled row, or none that the sample meets, every text will be ``und``.
    The counts that reach the driver are those of the sample's distinct words.
    """
    usable = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    totals = {r[0]: r[1] for r in usable.groupBy(lang).count().collect()}
    if not totals:
        return build({})
    # a table of a few rows teaches whole, or a sample by hash could miss it
    rate = F.create_map(*[F.lit(x) for k, n in sorted(totals.items()) for x in (k, min(0.8 if n >= MIN_CALIBRATION else 1.0, rows / n))])[F.col(lang)]
    # ids that are alike in text are spread by the hash's high bits
    place = (F.shiftrightunsigned(F.xxhash64(F.col(id_column), F.lit(11)), 11) / F.lit(float(2**53)))
    drawn = usable.select(F.col(lang).alias("lang"), F.col(text).alias("text"), (place / rate).alias("at")).where("at < 2")

    def count(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in slices(whole, "text"):
                held: dict = {}
                for language, one in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    own = held.setdefault(language, {})
                    for w in one.lower().encode().split():
                        own[w] = own.get(w, 0) + 1
                rows = [(k, w.decode(), n) for k, own in held.items() for w, n in own.items()]
                yield pa.RecordBatch.from_pylist([dict(zip(("lang", "word", "n"), r, strict=True)) for r in rows], pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))

    counted = (
        drawn.where("at < 1").select("lang", "text").mapInArrow(count, "lang string, word string, n bigint")
        .groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    )
    counts: dict[str, dict[str, int]] = {}
    for language, word, n in zip(*(counted.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
        if any(map(str.isalpha, word)):
            counts.setdefault(language, {})[word] = n
    if not counts:  # no word with a letter in the sample
        return build({})
    models = build(counts)
    held = predict(drawn.where("at >= 1").withColumn("_id", F.lit(0)), models, "_id", "text").select("lang_pred", "entropy").toArrow()
    found, entropy = np.array(held.column(0).to_pylist(), object), held.column(1).to_numpy(zero_copy_only=False)
    found, entropy = found[~np.isnan(entropy)], entropy[~np.isnan(entropy)]
    if len(entropy):
        enough = lambda own: own if len(own) >= MIN_CALIBRATION else entropy
        models.limits = REJECT_MARGIN * np.array([np.quantile(enough(entropy[found == x]), CALIBRATED_SHARE) for x in models.languages])
    return models


def predict(docs: DataFrame, models: Models, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score, entropy, accepted) for every row, from its whole text alone.

    Null texts and texts without a letter are ``und`` with score 0, entropy NaN, and not accepted.
    A tie goes to the language that sorts first. Ids may be null or repeated; other columns are not read.
    """
    key = docs.schema[id_column].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by the sample

    def run(batches):
        import pyarrow as pa

        own = shared.value
        for whole in batches:
            for batch in slices(whole, text):
                languages, sure, entropy = own.score(batch.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_column), pa.array(languages), pa.array(sure), pa.array(entropy), pa.array(own.accepted(languages, entropy))],
                    [id_column, "lang_pred", "score", "entropy", "accepted"],
                )

    return docs.select(id_column, text).mapInArrow(run, f"`{id_column}` {key}, lang_pred string, score double, entropy double, accepted boolean")


def keep_known_languages(docs: DataFrame, models: Models, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is accepted, unchanged; rows without a letter go."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        import pyarrow as pa

        own = shared.value
        for whole in batches:
            for batch in slices(whole, text):
                languages, _, entropy = own.score(batch.column(text).to_pylist())
                yield batch.filter(pa.array(own.accepted(languages, entropy)))

    return docs.mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~in_fold("doc_id", 4, 2))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    models = fit(training_rows(docs))
    found = predict(docs, models)
    return found.select("doc_id", in_fold("doc_id", 4, 2).alias("held_out"), "lang_pred", "score", "entropy", "accepted")


QUERIES = {"op2_language_id": op2_language_id}
ORACLES: dict = {}
