import tracemalloc

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dossierlens.llm import language, packing
from dossierlens.llm.token_counts import MergeCounter, piece_counter, token_counts

from .conftest import DOCS, prose

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
TEXTS = st.text(alphabet=st.sampled_from(list(" \n\t▁ab1.,é中😀<>sS'ΣİÁ​\xa0\x00")), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_counts_are_those_of_the_library(text):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert piece_counter(PIECES).count(text) == len(model.encode(text))


def test_counts_of_special_strings_and_long_runs():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for text in ["<s> </s><unk> <0x0A>", " " * 777, "a" * 5000, "\n" * 99, "ab" * 4000 + ".", "x,y, z."]:
        assert piece_counter(PIECES).count(text) == len(model.encode(text))


def test_merges_by_rank_then_from_the_left():
    counter = MergeCounter({"a": 9, "b": 9, "ab": 0, "ba": 1, "aba": 2}, prefix=False)
    assert counter.count("aba") == 1  # ab, then aba
    assert counter.count("aab") == 2
    assert counter.count("bab") == 2
    assert counter.count("é") == 2  # bytes of what is no piece
    with pytest.raises(ValueError):
        MergeCounter({"a▁b": 0})


def test_token_counts_of_odd_documents(spark, odd_documents):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = token_counts(odd_documents, PIECES).collect()
    texts = [r["text"] for r in odd_documents.collect()]
    assert [(r["n_bytes"], r["n_tokens"]) for r in found] == [
        (len((t or "").encode()), len(model.encode(t or ""))) for t in texts
    ]
    assert [r["over_limit"] for r in found] == [r["n_tokens"] > 4096 for r in found]
    assert any(r["over_limit"] for r in found)
    assert token_counts(odd_documents.limit(0), PIECES).count() == 0


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_word_ids_are_those_of_the_library(text):
    words = packing.word_ids(WORDS)
    assert words.ids(text) == words._ids(text)


def test_language_is_told_on_texts_not_learned_from(spark, rng):
    languages = {"xx": "abcde", "yy": "cdefg", "zz": "éàüöß"}
    rows = [(i, prose(rng, 40, languages[l]), l, "s", 1) for i in range(300) for l in [list(languages)[i % 3]]]
    docs = spark.createDataFrame(rows, DOCS)
    model = language.train(docs.where("doc_id < 200"))
    assert model.languages == ["xx", "yy", "zz"]
    found = language.identify(docs.where("doc_id >= 200"), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 98
    assert all(0.33 < r["score"] <= 1 for r in found)


def test_posteriors_match_brute_force(rng, monkeypatch):
    weights = np.random.default_rng(1).normal(size=(1 << 6, 3))
    model = language.Model(["a", "b", "c"], weights, np.log([0.5, 0.3, 0.2]))
    texts = [None, "", "12 3", "x", "Ab", "ÀÉ 😀 straße", *(prose(rng, n) for n in (1, 5, 40, 400)), "equal " * 50, "equal " * 50]
    monkeypatch.setattr(language, "ENTRIES", 100)  # several products
    for text, (lang, score) in zip(texts, language.classify_all(model, texts, 6), strict=True):
        if not text or not any(c.isalpha() for c in text):
            assert (lang, score) == ("und", 0.0)
            continue
        logs, code = model.prior.copy(), [ord(c) for c in text.lower()]
        for at in range(len(code)):
            mixed = 0
            for c, odd in zip(code[at : at + 3], language._ODD):
                mixed = (mixed + c) * int(odd) % 2**32
                logs += weights[((mixed ^ (mixed >> 15)) * 0x27D4EB2F % 2**32) >> 26]
        odds = np.exp(logs - logs.max())
        assert lang == "abc"[odds.argmax()] and score == pytest.approx(odds.max() / odds.sum())


def test_pieces_of_a_text_count_as_the_whole(rng):
    text = prose(rng, 300)
    for piece in (1, 2, 3, 7, 1000):
        assert (language.counted(text, 8, piece) == language.counted(text, 8)).all()


def test_long_texts_take_little_memory():
    model = language.Model([str(k) for k in range(10)], np.zeros((1 << language.BITS, 10)), np.zeros(10))
    text = "The cat sat on a mat. " * 900_000
    tracemalloc.start()
    # Posteriors are equal: the first of the alphabet.
    assert language.classify(model, text) == ("0", pytest.approx(0.1))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20


def test_too_many_languages_are_refused(table, monkeypatch):
    monkeypatch.setattr(language, "MODEL_BYTES", 2 * (8 << language.BITS))
    rows = [(k, "some text", lang, None, None) for k, lang in enumerate("aabc")]
    assert language.train(table(rows[:3], DOCS)).languages == ["a", "b"]
    with pytest.raises(ValueError, match="languages"):
        language.train(table(rows, DOCS))


def test_language_of_odd_documents(spark, odd_documents):
    model = language.train(odd_documents)
    assert model.languages == ["en", "fr"]
    found = language.identify(odd_documents, model)
    assert len(found.columns) == len(odd_documents.columns)  # clashing ones are replaced
    rows = found.collect()
    assert len(rows) == 10
    for r in rows:
        letters = bool(r["text"]) and any(c.isalpha() for c in r["text"])
        assert (r["lang_pred"] == "und") == (not letters)
        assert (r["score"] == 0) == (not letters)
    assert language.identify(odd_documents.limit(0), model).count() == 0
    nothing = language.train(odd_documents.limit(0))
    assert {r["lang_pred"] for r in language.identify(odd_documents, nothing).collect()} == {"und"}


def test_the_prediction_sees_the_text_alone(spark, rng):
    docs = spark.createDataFrame([(i, prose(rng, 20, "abc" if i % 2 else "xyz"), "p" if i % 2 else "q", "s", 1) for i in range(60)], DOCS)
    model = language.train(docs)
    other = docs.selectExpr("doc_id + 999 as doc_id", "text", "'zz' as lang", "'t' as source", "n_chars")
    assert [r[0] for r in language.identify(docs, model).select("lang_pred").collect()] == [
        r[0] for r in language.identify(other, model).select("lang_pred").collect()
    ]


def _best_fit(lengths, limit):
    rooms, sequences = [], 0
    for length in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= length]
        if fitting:
            room = min(fitting)
            rooms.remove(room)
        else:
            room, sequences = limit, sequences + 1
        rooms.append(room - length)
    return sequences


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), min_size=1, max_size=12))
def test_the_plan_is_best_fit_over_counts(histogram):
    slots, ranks = {}, {}
    for length, low, high, first, per, offset in packing.plan(histogram, 40):
        for rank in range(low, high):
            i = rank - low
            slots.setdefault(first + i // per, []).append((offset + length * (i % per), length))
            ranks.setdefault(length, []).append(rank)
    assert {length: sorted(found) for length, found in ranks.items()} == {l: list(range(n)) for l, n in histogram.items()}
    for placed in slots.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= 40
    assert len(slots) == _best_fit([l for l, n in histogram.items() for _ in range(n)], 40)


def test_packing_of_odd_documents(spark, odd_documents):
    import zlib

    import numpy as np

    tokenizer = Tokenizer.from_file(WORDS)
    found = packing.pack_documents(odd_documents, WORDS, limit=512).collect()
    expected = []
    for row in odd_documents.collect():
        ids = tokenizer.encode(row["text"] or "", add_special_tokens=False).ids + [1]
        for piece, begin in enumerate(range(0, len(ids), 512)):
            part = np.array(ids[begin : begin + 512], dtype="<u4")
            expected.append((row["doc_id"], piece, begin, len(part), zlib.crc32(part.tobytes())))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r[:5]) for r in found), key=key) == sorted(expected, key=key)
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in by_sequence.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= 512
    assert packing.pack_documents(odd_documents.limit(0), WORDS).count() == 0


def test_equal_lengths_are_ranked_across_groups(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "'a' as text")
    found = packing.pack_documents(docs, WORDS, limit=8)
    assert found.select("sequence_id", "offset").distinct().count() == 3000
    assert found.select("sequence_id").distinct().count() == 750


def test_a_word_that_is_known_costs_one_look(monkeypatch):
    """Only new words reach Python code, also where the cache is emptied within a text."""
    words, made = packing.WordIds(WORDS), []
    real = words._new
    words.seen = packing.Seen(3, lambda word: made.append(word) or real(word))
    monkeypatch.setattr(packing.Seen, "__contains__", lambda *_: pytest.fail("a second look"), raising=False)
    text = "red red\nred blue red blue"
    assert words.ids(text) == words._ids(text) and made == ["red", "blue"]
    text = "one two. Three, é Élan ß 4 &&& one one red"
    assert words.ids(text) == words._ids(text) and len(words.seen) <= 3
