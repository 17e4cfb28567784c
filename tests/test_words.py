import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from english_by_hand import stem
from dossierlens.functions import english
from dossierlens.functions.scoring import byte_length_norm
from dossierlens.functions.words import word_counts, words
from dossierlens.operators.terms import stem_vocabulary, tokenize, vocabulary


def test_words(spark):
    df = spark.createDataFrame([("It's Été-2011, über_all!",), ("",), ("--",)], "t string")
    plain = [r[0] for r in df.select(words(F.col("t"))).collect()]
    assert plain == [["it", "s", "été", "2011", "über", "all"], [], []]
    joined = df.select(words(F.col("t"), apostrophes=True)).first()[0]
    assert joined[0] == "it's"
    assert df.select(words(F.col("t"), limit=2)).first()[0] == ["it", "s"]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("The state's U.S. aid", "the state us aid"), ("O'Neil's rock'n'roll 's", "o'neil rock'n'roll s"), ("u.s.a u.s.a. a.", "u.s.a usa a"),
        ("See www.site.org. End.Next 3.5.", "see www.site.org end.next 3.5"), ("AT&T&T me@home", "at&t t me@home"),
        ("ann.b-c_d@mail.x-y.org, a@b.c.", "ann.b-c_d@mail.x-y.org a@b.c"), ("x2'y dogs' state’s", "x2 y dogs state s"), ("wi-fi über_all a.b.com", "wi fi über all a.b.com"),
        ("", ""), (" '. @ ", ""), ("a'b12 a@b12 é.à.", "a'b 12 a@b 12 éà"),
    ],
)
def test_word_forms(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(words(F.col("t"), forms=True)).first()[0] == expected.split()


def test_word_forms_of_long_odd_texts_take_linear_time(spark):
    df = spark.createDataFrame([("a." * 100_000,), ("a" * 200_000,), ("a-" * 100_000 + "@",), ("a'" * 100_000,)], "t string")
    assert [len(r[0]) for r in df.select(words(F.col("t"), forms=True)).collect()][:2] == [1, 1]


def test_tokenize_counts_from_zero(spark):
    df = spark.createDataFrame([(1, "b A b")], "id long, t string")
    assert [tuple(r) for r in tokenize(df, "id", "t").orderBy("pos").collect()] == [
        (1, 0, "b"), (1, 1, "a"), (1, 2, "b"),
    ]


def test_word_counts_match_a_counter(spark):
    rng = random.Random(7)
    rows = [(i, [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 40))]) for i in range(50)]
    df = spark.createDataFrame(rows, "id long, w array<string>")
    for least in (1, 2, 3):
        got = {
            r.id: {c.term: c.tf for c in (r.c or [])}
            for r in df.select("id", word_counts(F.col("w"), least).alias("c")).collect()
        }
        assert got == {i: {t: n for t, n in Counter(w).items() if n >= least} for i, w in rows}


@pytest.mark.parametrize(
    "word, expected",
    [
        # Pairs from the published sample vocabulary.
        ("consigned", "consign"), ("consistency", "consist"), ("consolatory", "consolatori"),
        ("consolidating", "consolid"), ("consolingly", "consol"), ("conspicuously", "conspicu"),
        ("conspiracy", "conspiraci"), ("conspirators", "conspir"), ("constables", "constabl"),
        ("constancy", "constanc"), ("knackeries", "knackeri"), ("knavish", "knavish"),
        ("kneeling", "kneel"), ("knightly", "knight"), ("knitted", "knit"), ("knives", "knive"),
        # The rules one by one.
        ("caresses", "caress"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("gaps", "gap"),
        ("kiwis", "kiwi"), ("hopping", "hop"), ("hoping", "hope"), ("hoped", "hope"), ("luxuriated", "luxuri"),
        ("sized", "size"), ("agreed", "agre"), ("feed", "feed"), ("cry", "cri"), ("by", "by"), ("say", "say"),
        ("generate", "generat"), ("generously", "generous"), ("communism", "communism"), ("arsenal", "arsenal"),
        ("skies", "sky"), ("dying", "die"), ("news", "news"), ("innings", "inning"), ("proceeded", "proceed"),
        ("rational", "ration"), ("relational", "relat"), ("analogies", "analog"), ("hopefully", "hope"),
        ("happiness", "happi"), ("adoption", "adopt"), ("controlling", "control"), ("youth", "youth"),
        ("boyish", "boyish"), ("dog's", "dog"), ("is", "is"), ("2011", "2011"),
    ],
)
def test_stem(word, expected):
    assert stem(word) == expected


def test_stem_vocabulary_has_one_row_per_word(spark):
    df = spark.createDataFrame([("Running runs run",), ("runs cats",)], "t string")
    got = {r.term: r.stem for r in stem_vocabulary(vocabulary(df, "t")).collect()}
    assert got == {"running": "run", "runs": "run", "run": "run", "cats": "cat"}


def test_byte_norm_keeps_two_mantissa_bits(spark):
    import struct

    def cut(n):
        bits = struct.unpack(">I", struct.pack(">f", 1 / n**0.5))[0] >> 21 << 21
        return struct.unpack(">f", struct.pack(">I", bits))[0]

    lengths = [*range(1, 2100), 4095, 4096, 4097, 65535, 65536, 65537, 10**6, 2**24, 2**30]
    df = spark.createDataFrame([(n,) for n in lengths], "n int")
    got = {r.n: r.x for r in df.select("n", byte_length_norm(F.col("n")).alias("x")).collect()}
    assert got == {n: cut(n) for n in lengths}


def test_stems_match_the_word_by_word_algorithm(spark):
    rng = random.Random(3)
    ends = [*english.STEP2, *english.STEP3, *english.STEP4, *english.PAST, "s", "ies", "ied", "sses", "us", "y", "'s", "ll", "e", "logi", ""]
    made = {
        "".join(rng.choice("aeioubcdtlysgnyz") for _ in range(rng.randint(0, 7))) + rng.choice(ends) + rng.choice(ends)
        for _ in range(5000)
    }
    made = sorted(made | {*english.WHOLE_WORDS, *english.KEPT_AFTER_1A, "generate", "arsenal", "été", "dog’s"} - {""})
    found = stem_vocabulary(spark.createDataFrame([(w,) for w in made], "term string"))
    assert {r.term: r.stem for r in found.collect()} == {w: stem(w) for w in made}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
