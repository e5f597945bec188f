"""Operators 2, 4, 8 and 9: what each document says by itself, against plain Python and the public library."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given as holds
from hypothesis import settings
from hypothesis import strategies as st

from pressweave.llm import fertility, language_id, licenses, pieces, queries

from . import fixtures

MODEL = queries.tokenizer_path()
LOWER = {c: c + 32 for c in range(65, 91)}


def every_row(spark):
    return fixtures.texts() + [(i + 1000, t) for i, t in fixtures.given(spark)]


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n, inside = Counter(windows), set()
    for i, x in enumerate(windows):
        if n[x] > 1:
            inside.update(range(i, i + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), len(w) < 20 or 100 * len(inside) > 30 * len(w)


def test_quality_counts(spark):
    rows = every_row(spark)
    got = {r.doc_id: r for r in fertility.quality(fixtures.documents(spark, rows, repeat=False), MODEL).collect()}
    assert len(got) == len(rows)
    for doc, text in rows:
        r = got[doc]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(text)
        assert not (r.base_failed and r.kept)
        if text and len(text) > 3:
            assert r.chars_per_token == pytest.approx(len(text) / r.n_tokens)


def test_quality_keeps_plain_prose_and_drops_noise(spark):
    rows = [(1, "The committee met on Tuesday to discuss the new budget, which several members had already criticised in the press. Nobody expected an agreement before the end of the month."), (2, "અ☃ᚠ ☠⚡\U00013080 " * 3 + " ".join(chr(0x13000 + i) * 3 for i in range(40)))]
    got = {r.doc_id: r.kept for r in fertility.quality(fixtures.documents(spark, rows, repeat=False), MODEL).collect()}
    assert got == {1: True, 2: False}
    assert fertility.quality(fixtures.empty(spark), MODEL).count() == 0
    assert fertility.quality(fixtures.documents(spark), MODEL).where("doc_id = 21 OR doc_id IS NULL").count() == 3
    assert fertility.quality(fixtures.documents(spark).drop("lang"), MODEL).count() > 0


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "text", "lang"), "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
    tried = [r for r in rows if r.held_out and r.lang and r.lang_pred != "und"]
    assert len(tried) > 100 and sum(r.lang == r.lang_pred for r in tried) / len(tried) > 0.95
    assert np.mean([r.ambiguous for r in rows]) < 0.05


def test_language_is_learned_from_rows_without_or_with_repeated_identifiers(spark):
    english = [f"the committee met on day {i} and discussed what the members had said about number {i * 7}" for i in range(3_000)]
    german = [f"der Ausschuss hat am Tag {i} getagt und über die Zahl {i * 7} gesprochen" for i in range(40)]
    rows = [(None, t, "en") for t in english] + [(k, t, "de") for k, t in enumerate(german)] + [(9, "le comité", "fr")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language_id.train(docs, train_rows=100)
    assert model.languages == ["de", "en", "fr"]
    got = {(r.lang, r.lang_pred) for r in language_id.predict(docs, model, keep=("lang",)).select("row.lang", "lang_pred").collect()}
    assert {("en", "en"), ("de", "de")} <= got and ("en", "de") not in got
    assert language_id.sample(docs, 100).count() < 400


def test_language_never_reads_the_label_of_its_row(spark):
    docs = spark.read.parquet(f"{fixtures.SF}/documents.parquet").limit(80)
    model = language_id.train(docs)
    a = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()}
    b = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(docs.drop("lang", "source"), model).collect()}
    assert a == b


def test_bits_weigh_by_unseen_rows(spark):
    """Two labels that can't be told apart make the bits that part them weigh less than the one that doesn't."""
    rng = np.random.default_rng(5)
    words = {"a": ["red", "green", "blue", "grey"], "b": ["zwei", "drei", "vier", "acht"], "c": ["zwei", "drei", "vier", "acht"]}
    rows = [(i, " ".join(rng.choice(words[k], 8)), k) for i, k in enumerate(rng.choice(list("abc"), 600).tolist())]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    apart = model.codes[1] != model.codes[2]
    assert apart.any() and not apart.all() and model.bit_weights[apart].max() < model.bit_weights[~apart].min()


def test_language_of_long_rows_only_is_learned(spark):
    rows = [(i, "the house and the garden", "en") for i in range(40)] + [(100 + i, "das haus und der garten " * (1000 + i), "de") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.identify(docs).where("doc_id >= 100").collect()} == {"de"}
    assert {r.lang_pred for r in language_id.identify(docs).where("doc_id < 100").collect()} == {"en"}


def test_language_edges(spark):
    got = {r.doc_id: r.lang_pred for r in language_id.identify(fixtures.documents(spark)).collect()}
    assert got[0] == got[1] == got[2] == "und" and got[3] == "en" and got[73] == "en"
    assert language_id.identify(fixtures.empty(spark)).count() == 0
    unlabelled = fixtures.documents(spark, [(4, "some text")], repeat=False).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert language_id.identify(unlabelled).first().lang_pred == "und"


@pytest.mark.parametrize("text", ["ab" * 500_000, "a" * 50_001, " " * 10_001, "erungschkeit" * 9_000 + "\u2603", "0123456789abcdef" * 9_000])
def test_pieces_of_long_unbroken_words(text):
    """Time in proportion to the length, and the library's ids."""
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    p = pieces.process_pieces(pieces.vocabulary(MODEL))
    assert p.encode(text) == np.array([library.bos_id(), *library.encode(text), library.eos_id()], dtype="<u4").tobytes()
    assert not any(len(k) > pieces.CACHE_LENGTH for cache in (p.units, p.done) for k in (*cache, *cache.old))


def phrases(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at, labels = [], set()
    for phrase, label in licenses.BASE:
        p = phrase.split()
        found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_license_base(spark):
    rows = every_row(spark)
    got = {r.doc_id: r for r in licenses.scan(fixtures.documents(spark, rows, repeat=False)).collect()}
    assert len(got) == len(rows)
    for doc, text in rows:
        r = got[doc]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == phrases(text), doc
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1


@pytest.mark.parametrize("end", ["\u0085", "\u2028", "\u2029"])
def test_license_places_beyond_other_line_ends(spark, end):
    one, two = "all rights reserved", "under cc by terms"
    texts = [f"a{end}b {one}", f"a {end} {one} {two}", f"{one} a{end}b {two}", f"{one} a {end} {two}", f"{one} {two} a{end}b", f"{end}{one} {two}", f"{one}{end} {two}", f"x{end}\n{one}\n{two}\n{end}"]
    got = {r.doc_id: r for r in licenses.scan(fixtures.documents(spark, list(enumerate(texts)), repeat=False)).collect()}
    for doc, text in enumerate(texts):
        r = got[doc]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == phrases(text), doc


def test_license_labels(spark):
    rows = [(k, f"intro {text.upper()} end") for k, (_, text, _) in enumerate(licenses.TEMPLATES)] + [(100, "public license general"), (101, "gnu " + "x " * 50 + "lesser general public license version")]
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan(fixtures.documents(spark, rows, repeat=False)).collect()}
    for k, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert label in got[k], (label, got[k])
    assert got[100] == [""]
    assert licenses.scan(fixtures.empty(spark)).count() == 0
    assert licenses.scan(fixtures.documents(spark)).where("doc_id = 21").count() == 2


def templates(text, df, n):
    """Labels and score of a text, from the places of all templates at every offset; df counts the n files that have a word."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    labels, score = set(filter(None, phrases(text)[4].split(","))), 0.0
    for label, template, key in licenses.TEMPLATES:
        t, k = template.split(), key.split()
        rare = sorted(range(len(t)), key=lambda i: (-np.log((n + 1) / (df[t[i]] + 0.5)), t[i], i))[: -(-len(t) // 2)]
        at = next(i for i in range(len(t)) if t[i : i + len(k)] == k)
        for o in range(-len(t), len(w)):
            share = sum(0 <= o + i < len(w) and w[o + i] == t[i] for i in rare) / len(rare)
            if share >= licenses.LEAST_SHARE and o + at >= 0 and w[o + at : o + at + len(k)] == k:
                labels, score = labels | {label}, max(score, share)
    return ",".join(sorted(labels)), score


def test_license_labels_of_texts_of_many_licenses(spark):
    every = [text for _, text, _ in licenses.TEMPLATES]
    vocabulary = " ".join(sorted({w for text in every for w in text.split()}))
    rows = [(1, " and ".join(every)), (2, vocabulary + " x " + every[10]), (3, " ".join(every[k] for k in (12, 2, 10))), (4, vocabulary)]
    rows += [(10 + k, "license version public") for k in range(30)]
    # the key phrase elsewhere in the file, more than once, and twice in a row
    rows += [(50, "mit license text here and elsewhere in the file released under the bla bla license"), (51, "mit license mit license released under the mit license"), (52, "released under the mit license released under the mit license"), (53, "apache license apache license licensed under the apache license version 2 0")]
    # near the least share: words taken from the end, the start and the middle of each template
    for k, text in enumerate(every):
        w = text.split()
        rows += [(10_000 + 100 * k + n, f"{vocabulary} x {' '.join(x)}") for n, x in enumerate([w[: len(w) * 2 // 3], w[len(w) // 3 :], [*w[: len(w) // 3], "y", *w[len(w) // 3 + 1 :]]])]
    rows += every_row(spark)[-200:]
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(fixtures.documents(spark, rows, repeat=False)).collect()}
    assert set(got[1][0].split(",")) == {label for label, _, _ in licenses.TEMPLATES} | {"gpl", "reserved", "cc-by"}
    assert got[50][0] == "" and got[51][0] == got[52][0] == "mit"
    df = Counter(w for _, text in rows for w in set(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))))
    for doc, text in dict(rows).items():
        labels, score = templates(text, df, len(rows))
        assert (got[doc][0], got[doc][1]) == (labels, pytest.approx(score)), doc


def test_license_labels_of_rows_without_or_with_a_repeated_identifier(spark):
    docs = spark.createDataFrame([(None, "Released under the MIT license"), (None, "all rights reserved"), (4, "Released under the MIT license"), (4, "nothing"), (4, None), (5, "released, under the MIT license!")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.labels, r.score) for r in licenses.scan(docs).collect())
    assert got == sorted([("None", "mit", 1.0), ("None", "reserved", 1.0), ("4", "mit", 1.0), ("4", "", 0.0), ("4", "", 0.0), ("5", "mit", 1.0)])


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_pieces_of_a_word_ask_the_automaton_once_where_the_longest_fit(monkeypatch):
    p = pieces.Pieces(pieces.vocabulary(MODEL))
    word = next(w for w in ("▁international,", "▁understanding.", "▁documentation,") if len(p.backtrack(w)) > 1 and p.backtrack(w) == [i for _, i in p.automaton.iter_long(w)])
    asked = []

    class Counted:
        def iter_long(self, text):
            asked.append(text)
            return automaton.iter_long(text)

    automaton = p.automaton
    monkeypatch.setattr(p, "automaton", Counted())
    assert p._part(word)[1] == word.replace("▁", " ")
    assert asked == [word]


def test_pairs_of_pieces_fit_as_merging_anew_says():
    p = pieces.Pieces(pieces.vocabulary(MODEL))
    r, ids, merged = random.Random(3), sorted(p.automaton.values()), []
    pairs = [(r.choice(ids), r.choice(ids)) for _ in range(5000)]
    want = [p.merge(p.pieces[a][0] + p.pieces[b][0]) == [p.pieces[a][0], p.pieces[b][0]] for a, b in pairs]
    p.merge, merge = lambda text, *watch: merged.append(text) or merge(text, *watch), p.merge
    assert [p._fits(a * len(p.pieces) + b) for a, b in pairs] == want and not all(want)
    # no pair is merged for the check, only each piece by itself
    assert all(text in p.id for text in merged)


def test_pieces_are_the_library_s(spark, library):
    rows = every_row(spark)
    got = {r.doc_id: r for r in pieces.encode_documents(fixtures.documents(spark, rows, repeat=False), MODEL).collect()}
    for doc, text in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want = (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        assert (got[doc].n_tokens, got[doc].ids_sha256, got[doc].decoded_sha256) == want, doc
    assert pieces.encode_documents(fixtures.empty(spark), MODEL).count() == 0
    assert pieces.encode_documents(fixtures.documents(spark), MODEL).where("doc_id = 21 OR doc_id IS NULL").count() == 3


@holds(st.text(st.one_of(st.sampled_from(" \n\tabcdeothning▁　ñ的😀́\r0123"), st.characters(exclude_categories=["Cs"])), max_size=60))
@settings(max_examples=400, deadline=None)
def test_any_text_is_encoded_and_decoded_like_the_library_does(library, text):
    p = pieces.process_pieces(pieces.vocabulary(MODEL))
    ids = np.frombuffer(p.encode(text), dtype="<u4").tolist()
    assert ids == library.encode(text, add_bos=True, add_eos=True)
    assert p.decode(ids) == library.decode(ids)


@holds(st.text("abeothin", max_size=200))
@settings(max_examples=200, deadline=None)
def test_long_words_backtrack(library, text):
    p = pieces.process_pieces(pieces.vocabulary(MODEL))
    assert np.frombuffer(p.encode(text), dtype="<u4").tolist() == library.encode(text, add_bos=True, add_eos=True)
