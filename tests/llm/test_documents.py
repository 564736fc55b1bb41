"""Operators on documents against brute force, libraries and held-out labels; and on odd rows."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from glimmer.llm import langid, lm_score, packing, piece_codec, quality, simhash, toxicity
from glimmer.llm.shared import in_fold

SF = "/root/testdata/sf0.001"


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", low) if w]


def fold(doc_id, n, k):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % n == k


def test_folds_follow_crc32(spark):
    rows = spark.range(50).select("id", in_fold("id", 7, 2).alias("f")).collect()
    assert all(r["f"] == fold(r["id"], 7, 2) for r in rows)


# ---- op1 ----


def test_pieces_equal_the_library(docs, odd_docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_codec.piece_model())
    for table in (docs, odd_docs):
        coded = piece_codec.encode(table, piece_codec.piece_model(), "doc_id").collect()
        texts = Counter(r["text"] or "" for r in table.select("text").collect())
        assert Counter(tuple(r["ids"]) for r in coded) == Counter(tuple(model.encode(t)) for t in texts.elements())


def test_pieces_decode_to_the_text(odd_docs, no_docs):
    path = piece_codec.piece_model()
    back = piece_codec.decode(piece_codec.encode(odd_docs, path), path)
    assert Counter(r["text"] for r in back.collect()) == Counter((r["text"] or "").replace("▁", " ") for r in odd_docs.collect())
    assert piece_codec.round_trip(odd_docs, path).where("not decoded_same").collect() == [] or all(
        "▁" in (r["text"] or "") for r in odd_docs.where("doc_id = 11").collect()
    )
    assert piece_codec.round_trip(no_docs, path).count() == 0


def test_long_segments_and_ties():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=piece_codec.piece_model())
    texts = ["ab" * 900, "x" * 700, " " * 90, "a\n\n b", "supercalifragilistic" * 9, "\ue000\ue001 \x07", "aaa bbb" * 40]
    assert piece_codec.Codec(piece_codec.piece_model()).encode(texts) == [np.array(model.encode(t), "<u4").tobytes() for t in texts]


# ---- op2 ----


def test_languages_of_held_out_documents(spark, docs):
    found = {r["doc_id"]: r for r in langid.op2_language_id(spark, SF).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [k for k in truth if fold(k, 4, 2)]
    assert {k for k, r in found.items() if r["held_out"]} == set(held)
    assert np.mean([found[k]["lang_pred"] == truth[k] for k in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_models_are_distributions():
    own = langid.build({"x": {"abab": 3, "ba": 2, "abc": 1}, "y": {"ccc": 2, "cab": 1}})
    letters = "abc "
    for context in ("", "a", "ab", "ba", "zz"):
        total = np.zeros(2)
        for letter in letters:
            with_letter, _ = own.word_scores([context + letter]) if letter != " " else own.word_scores([context])
            # the end of the word is predicted too: take it off
            if letter == " ":
                total += np.exp(with_letter[0] - _prefix(own, context))
            else:
                total += np.exp(_prefix(own, context + letter) - _prefix(own, context))
        assert (total <= 1 + 1e-5).all() and (total > 0.5).all()


def kneser_ney(counts, order, vocabulary):
    """Chance of a character after a context by the definition: absolute discounts on counts at the
    highest order, on numbers of different longer grams below, down to equal chances."""
    grams = {k: Counter() for k in range(1, order + 1)}
    for word, n in counts.items():
        line = " " * (order - 1) + word + " "
        for i in range(order - 1, len(line)):
            grams[order][line[i - order + 1 : i + 1]] += n
    for k in range(order - 1, 0, -1):
        for longer in grams[k + 1]:
            grams[k][longer[1:]] += 1

    def chance(context, char, k=order):
        if k == 0:
            return 1 / (vocabulary + 1)
        own = {g: n for g, n in grams[k].items() if g[:-1] == context[len(context) - k + 1 :]}
        lower = chance(context, char, k - 1)
        if not own:
            return lower
        once, twice = (sum(n == x for n in grams[k].values()) for x in (1, 2))
        discount = once / (once + 2 * twice) if once and twice else 0.5
        total = sum(own.values())
        seen = own.get(context[len(context) - k + 1 :] + char, 0)
        return max(seen - discount, 0) / total + discount * len(own) / total * lower

    return chance


def test_models_equal_kneser_ney_by_its_definition():
    counts = {"x": {"abab": 3, "ba": 2, "abc": 1, "cab": 1}, "y": {"ccc": 2, "cab": 1, "bc": 4}}
    own = langid.build(counts)
    words = ["abab", "ba", "cc", "abx", "z", "bcab"]
    got, sizes = own.word_scores(words)
    assert sizes.tolist() == [len(w) + 1 for w in words]
    for j, language in enumerate(("x", "y")):
        chance = kneser_ney(counts[language], langid.ORDER, 4)
        for i, w in enumerate(words):
            line = " " * (langid.ORDER - 1) + w + " "
            want = sum(math.log(chance(line[: k], line[k])) for k in range(langid.ORDER - 1, len(line)))
            assert got[i, j] == pytest.approx(want, rel=1e-4)


def test_other_languages_are_rejected(docs):
    models = langid.fit(docs.sparkSession.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    foreign = ["Det var en gang en konge som hadde tre sønner og et stort slott ved fjorden der alle kunne bo.", "Жили-были старик со старухой у самого синего моря в ветхой землянке.", "A fost odată ca niciodată un împărat care avea trei feciori viteji și frumoși."]
    names, _, entropy = models.score(foreign)
    assert not models.accepted(names, entropy).any()


def _prefix(models, text):
    """Log-probability of the letters of a word without its end."""
    codes, at = langid.spell([text])
    full, _ = models.word_scores([text])
    last = langid.gram_hashes(codes, at)
    before = langid.gram_hashes(codes, at - 1)
    out = np.zeros(len(models.languages))
    for k in range(langid.ORDER, 0, -1):
        place, hit = langid.find(models.grams[k], last[k][-1:])
        if hit[0]:
            return full[0] - (out + np.log(models.chance[k][place[0]]))
        place, hit = langid.find(models.contexts[k], before[k - 1][-1:])
        if hit[0]:
            out += np.log(models.back[k][place[0]])
    return full[0] - (out + np.log(models.floor))


def test_odd_texts_have_a_language(odd_docs, no_docs):
    models = langid.fit(odd_docs)
    rows = langid.predict(odd_docs, models).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r["doc_id"]: r for r in rows}
    for k in (5, 6, 7, 9):
        assert (by_id[k]["lang_pred"], by_id[k]["score"], by_id[k]["accepted"]) == ("und", 0.0, False)
    assert by_id[3]["lang_pred"] == "de"
    kept = langid.keep_known_languages(odd_docs, models)
    assert kept.columns == odd_docs.columns and kept.count() <= 9
    empty = langid.fit(no_docs)
    assert langid.predict(no_docs, empty).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd_docs, empty).collect()} == {"und"}


# ---- op3 ----


def brute_fingerprint(text):
    import xxhash

    w = words_of(text)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance=2):
    parent = list(range(len(fps)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return [top(i) for i in range(len(fps))]


def test_fingerprints_and_groups(spark, docs):
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: r["doc_id"])
    fps = [brute_fingerprint(r["text"]) for r in rows]
    groups = brute_components(fps)
    want = {r["doc_id"]: (f"{f:016x}", rows[g]["doc_id"]) for r, f, g in zip(rows, fps, groups)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op3_simhash_dedup(spark, SF).collect()} == want


@pytest.mark.parametrize("limit", [20_000, 5])
def test_links_are_exact_in_dense_groups(spark, monkeypatch, limit):
    """Chains of single and double flips around few centres, with buckets beyond the limit too."""
    rng = np.random.default_rng(1)
    fps = {int(x) for x in rng.integers(0, 2**63, 4)}
    for _ in range(160):
        base = list(fps)[int(rng.integers(len(fps)))]
        for b in rng.integers(0, 63, int(rng.integers(1, 4))):
            base ^= 1 << int(b)
        fps.add(base)
    own = sorted(fps)
    from glimmer.llm.components import components

    monkeypatch.setattr(simhash, "BUCKET_ROWS", limit)
    table = spark.createDataFrame([(x,) for x in own], "fp long").repartition(3)
    found = {r["node"]: r["component"] for r in components(simhash.links(table), "a", "b").collect()}
    label = brute_components(own)
    assert [found.get(x, x) for x in own] == [own[g] for g in label]


def test_odd_rows_have_groups(odd_docs, no_docs):
    rows = simhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    found = {r["doc_id"]: r["component_id"] for r in rows}
    assert found[2] == 1 and found[6] == 5 and found[7] == 5 and found[None] is None
    kept = simhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 8, 9, 10, 11]
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.drop_near_duplicates(no_docs).count() == 0


def test_repeated_ids_of_several_groups_stay(spark):
    """One id begins two groups, another has a row in a foreign group and is the least of its own."""
    one, two, three, four = ([f"{name}{i}" for i in range(40)] for name in ("red", "green", "blue", "grey"))
    rows = [(1, one), (1, two), (1, two), (2, one), (3, two), (4, three), (5, four), (4, one), (6, three)]
    table = spark.createDataFrame([(i, " ".join(words), "x") for i, words in rows], "doc_id long, text string, fp string").repartition(3)
    kept = sorted((r["doc_id"], r["text"].split()[0]) for r in simhash.drop_near_duplicates(table).collect())
    assert kept == [(1, "green0"), (1, "red0"), (4, "blue0"), (5, "grey0")]


# ---- op4 ----


def test_base_scores_and_the_model_beats_them(spark, docs):
    rows = docs.collect()
    train = Counter(w for r in rows if not fold(r["doc_id"], 7, 2) for w in [*words_of(r["text"]), "\n"])
    n, v = sum(train.values()), len(train)
    found = {r["doc_id"]: r for r in lm_score.op4_lm_scoring(spark, SF).collect()}
    for r in rows:
        tokens, got = [*words_of(r["text"]), "\n"], found[r["doc_id"]]
        assert (got["n_tokens"], got["n_known"], got["train_tokens"]) == (len(tokens), sum(train[t] > 0 for t in tokens), n)
        assert got["base_score"] == pytest.approx(sum(math.log10((train[t] + 1) / (n + v + 1)) for t in tokens))
    held = [x for x in found.values() if x["held_out"]]
    assert sum(x["score"] for x in held) > sum(x["base_score"] for x in held)


def small_model(units=23, width=5, seed=1):
    rng = np.random.default_rng(seed)
    mass = np.sort(rng.integers(1, 50, units))[::-1].astype(float)
    model = lm_score.LogBilinear.new(mass, width, seed)
    for x in model.parts():
        x += rng.normal(0, 0.5, x.shape).astype(np.float32) * (x > -60)
    return mass, model


def test_chances_follow_their_definition_and_sum_to_one():
    """Group softmax times softmax within the group, token by token."""
    mass, m = small_model()
    for before in ([3, 7], [0, 0], [22, 1]):
        q = sum(m.context[u] * m.reach[k] for k, u in enumerate(before)).astype(float)
        groups = np.exp(m.group[:, :-1] @ q + m.group[:, -1])
        want = []
        for u in range(len(mass)):
            own = m.unit[u // 5 * 5 : u // 5 * 5 + 5]
            inner = np.exp(own[:, :-1] @ q + own[:, -1])
            want.append(math.log(groups[u // 5] / groups.sum() * inner[u % 5] / inner.sum()))
        got = m.log_chances(np.array([before] * len(mass)), np.arange(len(mass)))
        assert np.allclose(got, want, atol=1e-4) and np.exp(got).sum() == pytest.approx(1, abs=1e-4)


def test_untrained_model_is_the_unigram_model():
    mass = np.array([9.0, 5, 3, 2, 1])
    model = lm_score.LogBilinear.new(mass, 2)
    model.context[:] = 0
    assert np.allclose(np.exp(model.log_chances(np.zeros((5, 2), int), np.arange(5))), mass / 20)


def test_noise_contrast_learns_what_follows():
    """In a language where each unit has one follower, two steps of context are told apart."""
    rng = np.random.default_rng(4)
    mass = np.ones(30)
    model = lm_score.LogBilinear.new(mass, 6)
    own = lm_score.Trainer(model, mass, rng)
    follow = rng.permutation(30)
    for _ in range(400):
        before = rng.integers(0, 30, (512, 2))
        own.step(before, follow[before[:, 0]])
    before = rng.integers(0, 30, (200, 2))
    assert np.exp(model.log_chances(before, follow[before[:, 0]])).mean() > 0.8


def test_tokens_of_a_group_share_its_noise():
    """The rows that a step moves for noise are as many as its groups need, however many tokens it has."""
    mass, m = small_model()
    own, rng = lm_score.Trainer(m, mass, np.random.default_rng(2)), np.random.default_rng(3)
    units = rng.integers(0, 15, 900)
    own.step(rng.integers(0, 23, (900, 2)), units)
    groups = len(set((units // 5).tolist()))
    assert own.drawn[3].sum() == 900 + groups * lm_score.UNIT_NOISE
    assert own.drawn[2].sum() == 900 + lm_score.GROUP_NOISE and own.drawn[0].sum() == 1800


def test_sums_of_runs_are_those_of_their_rows():
    """Short runs are added side by side, long ones each for itself; every row counts once."""
    rng = np.random.default_rng(6)
    for many in ([1], [lm_score.LONG_RUN, 1], [40, 9, 8, 8, 7, 3, 2, 1, 1], [2] * 5):
        many, n = np.array(many), sum(many)
        rows, order = rng.normal(size=(n, 3)).astype(np.float32), rng.permutation(n)
        starts = np.cumsum(many) - many
        got = lm_score.run_sums(rows, order, starts, many)
        assert np.allclose(got, [rows[order[a : a + k]].sum(0) for a, k in zip(starts, many, strict=True)], atol=1e-5)


def test_short_unit_numbers_stay_short_and_change_nothing():
    mass, m = small_model()
    units = np.random.default_rng(3).integers(0, 23, 900)
    short = units.astype("<u2")
    assert lm_score.units_before(short, 4).dtype == short.dtype
    parts = []
    for u in (units, short):
        model = small_model()[1]
        lm_score.Trainer(model, mass, np.random.default_rng(2)).step(lm_score.units_before(u, 4), u)
        parts.append((model.parts(), m.log_chances(lm_score.units_before(u, 4), u)))
    assert all(np.array_equal(a, b) for a, b in zip(parts[0][0], parts[1][0], strict=True)) and np.array_equal(parts[0][1], parts[1][1])


def test_chances_beyond_single_precision_are_shifted():
    mass, m = small_model()
    m.group[2, -1], m.unit[11, -1] = 200, 300  # exp overflows
    found = m.log_chances(np.array([[3, 7]] * 23), np.arange(23))
    assert np.isfinite(found).all() and found[11] == pytest.approx(0, abs=1e-4) and (np.delete(found, 11) < -90).all()


def test_contexts_do_not_cross_texts():
    assert lm_score.units_before(np.array([1, 2, 3, 9, 9, 4, 9]), 9).tolist() == [[9, 9], [1, 9], [2, 1], [3, 2], [9, 9], [9, 9], [4, 9]]


@pytest.mark.parametrize("passes", [1, 2, 5])
def test_every_token_teaches_equally_often(passes):
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 1000):
        places = np.concatenate([lm_score.visits(n, turn, passes, rng) for turn in range(lm_score.ROUNDS)])
        assert np.bincount(places.astype(int), minlength=n).tolist() == [passes] * n


def test_scores_are_the_model_and_the_counts(spark, docs, monkeypatch):
    """The score of every text from the trained model, token by token, with words by their form in units."""
    kept = {}
    for name in ("vocabulary", "train"):
        real = getattr(lm_score, name)
        monkeypatch.setattr(lm_score, name, lambda *a, real=real, name=name, **k: kept.setdefault(name, real(*a, **k)))
    monkeypatch.setattr(lm_score, "HEAD_WORDS", 300)
    found = {r["doc_id"]: r for r in lm_score.op4_lm_scoring(spark, SF).collect()}
    words, model = kept["vocabulary"], kept["train"]
    rows = docs.collect()
    train = Counter(w for r in rows if not fold(r["doc_id"], 7, 2) for w in [*words_of(r["text"]), "\n"])
    for r in rows[:60]:
        tokens, total = [*words_of(r["text"]), "\n"], 0.0
        units, parts = [], []
        for t in tokens:
            raw = [t.encode()]
            count, unit, norm = (x[0] for x in words.look_up(lm_score.token_hashes(raw), lm_score.forms(raw)))
            units.append(int(unit))
            parts.append(math.log10((train[t] + 1) / norm) if norm else 0.0)
            assert count in (-1, train[t])
        seen = [words.end, words.end]
        for u, part in zip(units, parts):
            total += model.log_chances(np.array([seen[::-1]]), np.array([u]))[0] / math.log(10) + part
            seen = [seen[1], u]
        assert found[r["doc_id"]]["score"] == pytest.approx(total, rel=1e-5, abs=1e-3)


def test_rare_words_meet_their_counts(odd_docs, no_docs, monkeypatch):
    """With a tiny head almost all counts come by the shuffle; the scores stay the same."""
    whole = {(r["doc_id"], r["n_tokens"]): (r["n_known"], round(r["base_score"], 8)) for r in lm_score.score(odd_docs).collect()}
    monkeypatch.setattr(lm_score, "HEAD_WORDS", 3)
    small = {(r["doc_id"], r["n_tokens"]): (r["n_known"], round(r["base_score"], 8)) for r in lm_score.score(odd_docs).collect()}
    assert whole == small and len(lm_score.score(odd_docs).collect()) == odd_docs.count()
    untrained = lm_score.score(odd_docs, odd_docs.doc_id < 0).collect()
    assert len(untrained) == odd_docs.count() and all(r["n_known"] == 0 and math.isfinite(r["score"]) for r in untrained)
    assert lm_score.score(no_docs).count() == 0


# ---- op5 ----


def test_base_counts(docs, odd_docs, no_docs):
    for table in (docs, odd_docs):
        got = Counter()
        for r in quality.quality(table, ("doc_id",)).collect():
            got[(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])] += 1
        want = Counter()
        for r in table.select("doc_id", "text").collect():
            t = r["text"] or ""
            w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
            seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
            covered = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
            lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
            failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
            want[(r["doc_id"], len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed)] += 1
        assert got == want
    assert quality.quality(no_docs, ("doc_id",)).count() == 0 and quality.keep_good(no_docs).columns == no_docs.columns


def test_verdicts_follow_the_labels(spark):
    sf = "/root/testdata/sf0.01"
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in quality.op5_quality_rules(spark, sf).collect() if r["doc_id"] in marks and not r["base_failed"]]
    good, bad = ([r["kept"] for r in rows if marks[r["doc_id"]] == q] for q in (1, 0))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.2


def test_small_languages_are_not_judged_by_others(docs):
    """Sixteen long Spanish documents give no reference: the base rules alone decide, also without any reference."""
    from pyspark.sql import functions as F

    found = quality.quality(docs, ("doc_id", "lang")).collect()
    spanish = [r for r in found if r["lang"] == "es"]
    assert len(spanish) == 17 and all(r["kept"] != r["base_failed"] and r["word_distance"] is None for r in spanish)
    assert any(not r["kept"] and not r["base_failed"] for r in found)
    kept = {r["doc_id"] for r in quality.keep_good(docs).collect()}
    assert kept == {r["doc_id"] for r in found if r["kept"]}
    alone = quality.quality(docs.where("lang = 'es'")).collect()
    assert len(alone) == 17 and all(r["kept"] != r["base_failed"] and r["char_distance"] is None for r in alone)
    # rows without a language are judged by the languages that are known, and are none of their own
    unnamed = docs.withColumn("lang", F.when(docs.lang != "es", docs.lang))
    without = {r["doc_id"]: r["kept"] for r in quality.quality(unnamed).collect()}
    assert sum(not without[r["doc_id"]] and not r["base_failed"] for r in spanish) >= 10
    assert all(r["char_distance"] is None for r in quality.quality(docs.withColumn("lang", F.lit(None).cast("string"))).collect())


# ---- op9 ----


def test_packing_is_exact_and_tight(docs, odd_docs, no_docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.word_tokenizer())
    for table in (docs, odd_docs):
        rows = packing.pack(table, packing.word_tokenizer(), keep_ids=True).collect()
        texts = Counter((r["doc_id"], tuple(plain.encode(r["text"] or "", add_special_tokens=False).ids) + (0,)) for r in table.select("doc_id", "text").collect())
        whole: dict = {}
        for (doc_id, ids), n in texts.items():
            for start in range(0, len(ids), 2048):
                whole[(doc_id, start // 2048, start, ids[start : start + 2048])] = n
        got = Counter((r["doc_id"], r["piece"], r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in rows)
        assert got == whole
        assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) and r["length"] == len(r["ids"]) // 4 for r in rows)
        places: dict = {}
        for r in rows:
            places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for held in places.values():
            at = 0
            for offset, length in sorted(held):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(places) <= math.ceil(sum(r["length"] for r in rows) / 2048) + 1
    assert packing.pack(no_docs, packing.word_tokenizer()).count() == 0


def exact_bins(lengths, capacity):
    """Fewest bins by trying all placements."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + lengths[i] <= capacity:
                place(i + 1, [*bins[:k], bins[k] + lengths[i], *bins[k + 1 :]])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best


@pytest.mark.parametrize(("low", "high"), [(5, 60), (20, 50), (26, 45), (1, 90)])
def test_bin_completion_is_optimal_on_small_inputs(low, high):
    rng = np.random.default_rng(low)
    for i in range(60):
        lengths = sorted((int(x) for x in rng.integers(low, high, 7 + i % 5)), reverse=True)
        counts = np.bincount(lengths, minlength=101)
        runs = packing.complete_bins(counts, 100, None)
        assert sorted((x for r in runs for x in r.lengths * r.times), reverse=True) == lengths
        assert all(sum(r.lengths) <= 100 for r in runs)
        best = exact_bins(lengths, 100)
        assert sum(r.times for r in runs) == best >= packing.fewest_possible(counts, 100)


def test_search_beats_best_fit_and_ends():
    counts = np.bincount([36, 33, 31] * 40, minlength=101)  # best fit needs more than the 40 that fit
    assert sum(r.times for r in packing.best_fit(counts, 100)) > 40
    assert sum(r.times for r in packing.complete_bins(counts, 100)) == packing.fewest_possible(counts, 100) == 40
    rng = np.random.default_rng(0)
    hard = np.bincount(rng.integers(600, 900, 20_000), minlength=2049)
    runs = packing.complete_bins(hard, 2048, 20_000)
    assert sum(r.times * len(r.lengths) for r in runs) == 20_000 and all(sum(r.lengths) <= 2048 for r in runs)


# ---- op10 ----


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in toxicity.op10_toxicity(spark, sf).collect()}
    marks = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(rows[k]["predicted"], y) for k, y in marks.items() if fold(k, 5, 0)]
    assert all(rows[k]["held_out"] == fold(k, 5, 0) for k in rows)
    assert np.mean([p == y for p, y in held]) > 0.94 and np.mean([p for p, y in held if y]) > 0.75
    assert all((r["predicted"] == 1) == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows.values())


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 0), (8, 1), (9, 0), (None, 1), (10, 0), (10, 1), (5, None)], "doc_id long, toxic int")
    net = toxicity.fit(odd_docs, labels)
    rows = toxicity.score(odd_docs, net).collect()
    assert len(rows) == odd_docs.count() and len({r["score"] for r in rows if r["doc_id"] in (5, 6, 7)}) == 1
    assert toxicity.score(no_docs, toxicity.fit(no_docs, labels)).count() == 0
    assert toxicity.score(odd_docs, toxicity.fit(odd_docs, labels.where("false"))).count() == odd_docs.count()


def slow_forward(net, words):
    """The network by its definition: one word, filter and place at a time."""
    def vector(word):
        return sum(net.table[b].astype(float) for b in toxicity.word_features([word])[0])

    rows = [vector(w) for w in words]
    best = []
    for kernel, shift in zip(net.kernels, net.shifts):
        for f in range(toxicity.FILTERS):
            top = 0.0
            for at in range(len(rows)):
                top = max(top, float(shift[f]) + sum(float(rows[at + k] @ kernel[k][:, f]) for k in range(len(kernel)) if at + k < len(rows)))
            best.append(top)
    return float(np.dot(best, net.weights) + net.bias)


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 200_000])
def test_network_follows_its_definition_in_any_chunks(chunk):
    rng = np.random.default_rng(chunk)
    net = toxicity.Network.new(rng)
    net.table *= 20
    net.shifts = [rng.normal(size=toxicity.FILTERS).astype(np.float32) for _ in toxicity.WIDTHS]
    texts = [[f"w{i}".encode() for i in rng.integers(0, 50, n)] for n in (0, 1, 2, 3, 7, 8, 9, 23, 60)]
    words = sorted({w for t in texts for w in t})
    ids = np.array([words.index(w) for t in texts for w in t])
    got, _ = net.logits(ids, np.cumsum([len(t) for t in texts]), toxicity.word_features(words), chunk)
    assert np.allclose(got, [slow_forward(net, t) for t in texts], atol=1e-4)


def test_repeated_ids_do_not_swell_the_sample(spark, monkeypatch):
    rows = [(i % 4, f"bad words here {i}" if i % 2 else f"kind words there {i}", "en") for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, toxic int")
    seen = []
    real = toxicity.train
    monkeypatch.setattr(toxicity, "train", lambda texts, y, **k: seen.append(len(texts)) or real(texts, y, **k))
    net = toxicity.fit(table, labels, sample={0: 40, 1: 40})
    assert 30 <= seen[0] <= 100
    assert [round(x) for x in net.score(["bad words here", "kind words there"])] == [1, 0]


def test_near_duplicates_go_alike_by_broadcast_and_shuffle(spark, odd_docs, docs, monkeypatch):
    """Columns of clashing names, 100,000 equal rows, and both joins."""
    from pyspark.sql import functions as F

    hot = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("").alias("text"), F.lit("x").alias("_rows"), F.lit(1).alias("id"))
    assert [(r["doc_id"], r["_rows"], r["id"]) for r in simhash.drop_near_duplicates(hot).collect()] == [(7, "x", 1)]
    assert simhash.drop_near_duplicates(spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))).collect()[0]["doc_id"] == 0
    for table in (odd_docs, docs):
        groups = simhash.near_duplicates(table).collect()
        want = {r["component_id"] for r in groups if r["doc_id"] is not None}
        seen = []
        for most in (2_000_000, -1):
            monkeypatch.setattr(simhash, "BROADCAST_IDS", most)
            kept = simhash.drop_near_duplicates(table)
            assert kept.columns == table.columns
            seen.append(sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()))
        assert seen[0] == seen[1] and {k for k, _ in seen[0]} - {"None"} == {str(x) for x in want}


def test_packing_by_numbers_of_pieces():
    """Pieces of a third of a sequence, more or less: best fit pairs them up, the search makes triples."""
    counts = np.bincount(np.random.default_rng(1).integers(600, 901, 20_000), minlength=2049)
    runs = packing.complete_bins(counts, 2048, 60_000)
    given = np.zeros(2049, np.int64)
    for run in runs:
        assert sum(run.lengths) <= 2048
        np.add.at(given, run.lengths, run.times)
    found, least = sum(r.times for r in runs), packing.fewest_possible(counts, 2048)
    assert (given == counts).all() and found <= 8_260 and found <= 1.02 * least
    assert sum(r.times for r in packing.best_fit(counts, 2048)) > 8_600


def test_bounds_by_numbers_hold():
    rng = np.random.default_rng(3)
    for _ in range(200):
        counts = np.bincount(rng.integers(1, 41, int(rng.integers(1, 9))), minlength=41)
        optimal = sum(r.times for r in packing.complete_bins(counts, 40, None))
        assert packing.by_numbers(counts, 40) <= packing.fewest_possible(counts, 40) <= optimal
