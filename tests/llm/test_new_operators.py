"""Fill-in-the-middle, document fingerprints and token alignment against plain definitions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from glimmer.llm import document_fingerprint as D
from glimmer.llm import fill_in_middle as M
from glimmer.llm import token_alignment as T

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


# --- fill in the middle


def fim_by_definition(key, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    p, q = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    a, b, c = "".join(units[:p]), "".join(units[p:q]), "".join(units[q:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(a), len(b), f"<S>{c}<P>{a}<M>{b}"
    return len(units), "psm", len(a), len(b), f"<P>{a}<S>{c}<M>{b}"


def test_fill_in_middle_by_definition():
    draw = random.Random(5)
    texts = ["", "a", "é", "<", "<P", "a<P>b", "x<S>", "aa<M", "<P<P", "ab" * 4000, "\n\n", "𝕏a𝕏", "İı", None, "\x00a"]
    texts += ["".join(draw.choice("abZ <>PSM\né𝕏") for _ in range(draw.randrange(30))) for _ in range(600)]
    seen = Counter()
    for key, text in [*enumerate(texts), (None, "some words"), (10**18, "x y")]:
        n, form, prefix, middle, output = fim_by_definition(key, text)
        made = M.transform(text, key)
        seen[form] += 1
        assert (made.n, made.form, made.output.text()) == (n, form, output)
        assert (prefix, middle) == ((None, None) if made.first is None else (made.first, made.second - made.first))
        assert M.restore(output, form).text() == (text or "") and made.output.sha256() == hashlib.sha256(output.encode()).hexdigest()
    assert min(seen[f] for f in ("plain", "spm", "psm")) > 30


def test_piece_tables_cut_anywhere():
    own = M.PieceTable("abcdef").arranged("psm", 2, 4)
    assert own.text() == "<P>ab<S>ef<M>cd"
    for p in range(len(own.text()) + 1):
        for q in range(p, len(own.text()) + 1):
            parts = own.cut(p, q)
            assert ["".join(M.PieceTable("abcdef", x).stream()) for x in parts] == [own.text()[:p], own.text()[p:q], own.text()[q:]]
            assert all(d.length for x in parts for d in x)


def test_fill_in_middle_of_odd_rows(spark, odd_docs, no_docs):
    got = rows_of(M.fill_in_middle(odd_docs), "doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored_sha256")
    want = []
    for r in odd_docs.collect():
        made = fim_by_definition(r["doc_id"], r["text"])
        want.append((r["doc_id"], *made, hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert M.fill_in_middle(no_docs).count() == 0


# --- document fingerprints


def spots_by_definition(text):
    common = set(D.anchors())
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low) if w]
    content = [i for i, w in enumerate(words) if w not in common]
    found = set()
    for j, i in enumerate(content):
        if j == 0 or words[i - 1] in common:
            anchor = words[i - 1] if i and words[i - 1] in common else "^"
            found.add(" ".join([anchor, *[words[k] for k in content[j : j + D.CHAIN]]]))
    if not content and words:
        found = {" ".join(words)}
    return {hashlib.md5(s.encode()).hexdigest()[: D.DIGITS] for s in found}


def like(a, b):
    return 1.0 if a == b else len(a & b) / len(a | b)


def test_signatures_by_definition(spark, odd_docs, docs):
    for table in (odd_docs, docs):
        for r in table.select("text", D.signatures(table["text"]).alias("s")).collect():
            assert r["s"] == sorted(spots_by_definition(r["text"]))


def edits_by_definition(rows):
    """rows: (id, text); ties by text, null ids last."""
    order = sorted([(i, t or "") for i, t in rows if i is not None], key=lambda x: (-x[0], x[1])) + sorted((i, t or "") for i, t in rows if i is None)
    out = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        own = spots_by_definition(t)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(sorted(own)), round(like(own, spots_by_definition(edited)), 9), round(like(own, spots_by_definition(after)), 9)))
    return sorted(out, key=str)


@pytest.mark.parametrize("ids", ["odd", "dense", "sparse", "uneven"])
def test_fingerprints_and_edits(spark, odd_docs, docs, ids, monkeypatch):
    monkeypatch.setattr(D, "NEIGHBOURS", 8)
    table = odd_docs
    if ids != "odd":
        draw = random.Random(2)
        texts = [r["text"] for r in docs.select("text").orderBy("doc_id").limit(150).collect()]
        make = {"dense": lambda k: k - 70, "sparse": lambda k: k * 10**13 - 5, "uneven": lambda k: k if k < 140 else draw.randrange(2**60)}[ids]
        table = spark.createDataFrame([(make(k), t[:400]) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in D.fingerprints(table).collect()]
    assert sorted(got, key=str) == edits_by_definition([(r["doc_id"], r["text"]) for r in table.collect()])


def test_fingerprints_of_few_rows(spark, no_docs):
    assert D.fingerprints(no_docs).count() == 0
    row = D.fingerprints(spark.createDataFrame([(3, "The cat sat on the old mat in a hall")], "doc_id long, text string")).first()
    assert row["near_next"] == 1.0 and 0 < row["near_edited"] < 1


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_near_matches_lose_none(spark, odd_docs, least):
    draw = random.Random(9)
    words = "the of and in a to fox dog hill tree river stone cloud field house bird".split()
    base = [[draw.choice(words) for _ in range(draw.randrange(3, 60))] for _ in range(25)]
    texts = [" ".join(w if draw.random() > 0.03 * (k % 4) else draw.choice(words) for w in b) for b in base for k in range(5)]
    table = spark.createDataFrame(list(enumerate([*texts, "", None, "the of", "THE  of!"])), "doc_id long, text string")
    asked = table.where("doc_id % 3 = 0")
    spots = {r["doc_id"]: spots_by_definition(r["text"]) for r in table.collect()}
    want = sorted((a, b, round(like(spots[a], spots[b]), 9)) for a in spots if a % 3 == 0 for b in spots if like(spots[a], spots[b]) >= least)
    assert sorted((r["query"], r["doc"], round(r["likeness"], 9)) for r in D.near_matches(asked, table, least).collect()) == want
    assert D.near_matches(odd_docs, odd_docs).count() >= odd_docs.count() and D.near_matches(odd_docs.where("false"), odd_docs).count() == 0


# --- token alignment


def coded(text):
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(A)
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=B)
    of = {letter: b for b, letter in T.ByteTokenizer.letters().items()}
    own = [(i, bytes(of[c] for c in first.id_to_token(i))) for i in first.encode(" " + text, add_special_tokens=False).ids]
    other = [(i, bytes([int(second.id_to_piece(i)[3:5], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode()) for i in second.encode(text)]
    return own, other


def alignments_by_definition(texts):
    links, about = [], []
    for text in texts:
        a, b = coded(text) if text else ([], [])
        want = b" " + (text or "").encode()
        if not text or any(b"".join(x for _, x in y) != want for y in (a, b)):
            links.append([])
            about.append((0, 0, 0, 0, ""))
            continue
        ends = [np.cumsum([len(x) for _, x in y]) for y in (a, b)]
        starts = [e - [len(x) for _, x in y] for e, y in zip(ends, (a, b), strict=True)]
        own = [(a[i][0], b[j][0]) for i in range(len(a)) for j in range(len(b)) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]]
        groups, i, j = [], 0, 0
        for e in sorted({*ends[0].tolist()} & {*ends[1].tolist()}):
            p, q = int(np.searchsorted(ends[0], e)) + 1, int(np.searchsorted(ends[1], e)) + 1
            groups.append(",".join(str(x) for x, _ in a[i:p]) + "|" + ",".join(str(x) for x, _ in b[j:q]))
            i, j = p, q
        links.append(own)
        about.append((len(a), len(b), len(groups), len(own), ";".join(groups)))
    times, top = Counter(x for own in links for x in own), defaultdict(int)
    for (_, y), n in times.items():
        top[y] = max(top[y], n)
    return [(*x[:4], sum(times[p] == top[p[1]] for p in own), sum(times[p] for p in own), x[4]) for x, own in zip(about, links, strict=True)]


def aligned(df):
    return {r["doc_id"]: (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups"]) for r in df.collect()}


def test_alignment_by_definition(spark, docs):
    odd = ["", None, " ", "  a  b ", "x\n\n y\t<s></s><unk> <|endoftext|>", "▁a ▁", "日本語 テキスト𝕏", "\x00\x01 a", "don't I'll we've they're it's", "aaaa" * 300, "é" * 50, "123 4567 !!!", "a b　c\u0085d e\x1cf", "0x7f <0x0A>"]
    texts = odd + [r["text"][:600] for r in docs.orderBy("doc_id").limit(60).collect()]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = aligned(T.align_tokens(table, A, B, keep_groups=True))
    want = alignments_by_definition(texts)
    for k, w in enumerate(want):
        assert got[k] == w, texts[k]


def test_chunks_do_not_matter(spark, docs):
    few, many = (T.align_tokens(docs.repartition(n), A, B).drop("groups") for n in (1, 7))
    assert rows_of(few, *few.columns) == rows_of(many, *many.columns)


def test_alignment_of_odd_rows(spark, odd_docs, no_docs):
    got = T.align_tokens(odd_docs, A, B, keep_groups=True).collect()
    rows = odd_docs.collect()
    want = alignments_by_definition([r["text"] if r["text"] is None or len(r["text"]) < 5000 else "" for r in rows])
    short = [(r["doc_id"], w[0], w[2], w[6]) for r, w in zip(rows, want, strict=True) if r["text"] is None or len(r["text"]) < 5000]
    assert sorted(((r["doc_id"], r["n_a"], r["n_groups"], r["groups"]) for r in got if r["n_a"] < 2000), key=str) == sorted(short, key=str)
    assert len(got) == len(rows) and T.align_tokens(no_docs, A, B).count() == 0
