"""Documents that hold benchmark items, also with other numbers, names or units.

Texts become templates: numbers, names and units give way to a placeholder of their type,
all else is lower-cased words. Windows of a template are joined by hash with the windows of
the benchmark's templates. Where enough of an item is covered, the fillings of the slots are
compared: a re-worded question replaces each number by one number and each name by one name
of its own, so an inconsistent filling is a chance likeness and is dropped.

Whether a capitalised word that begins a sentence is a name cannot be seen. Documents read it as
one; of items both readings are joined. Windows of the plain words, with what fills the slots, are
a second key, so that a verbatim copy is found whatever stands around it; a window without a slot
has one key only. Items of fewer than ``MIN_WORDS`` words have the plain key alone. One pass over
the texts makes the windows of all sizes that items have.

All of it is DataFrame functions; nothing runs in Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, small

WINDOW = 8
"""Template words per window; an item of fewer words is one window of its own length."""

MIN_WORDS = 4
"""The template of an item with fewer words says too little; it is matched as it is filled."""

MIN_LITERAL = 0.5
"""The least share of a window that is words, not placeholders; windows of less are only
joined as they are filled."""

MIN_COVERAGE = 0.5
"""The least share in matched windows, of an item's words or of those in windows that have a template."""

NAME, NUMBER, UNIT, POINT = "\x01", "\x02", "\x03", "\x04"
MARKS = NAME + NUMBER + UNIT
"""``POINT`` stands for a point, comma, colon or slash inside a number."""

# A capitalised word inside a sentence; what begins one may be any word. Patterns begin with
# the test that fails soonest.
_NAME = r"(?=\p{Lu})(?<=[\p{L}\p{N},;:] )\p{Lu}"
# Any capitalised word.
_CAPITALISED = r"(?=\p{Lu})(?<![\p{L}\p{N}])\p{Lu}"
_INNER = r"[.,:/](?=[0-9])(?<=[0-9][.,:/])"
_NUMBER = rf"(?=[0-9])(?<![\p{{L}}\p{{N}}{POINT}])"
# Units, which stand behind a digit, and number words.
_UNITS = (
    r"(?i)([0-9]) ?(%|°|km|cm|mm|m|kg|g|mg|l|ml|s|h|min|hours?|minutes?|seconds?|days?|weeks?|months?|years?|"
    r"meters?|metres?|miles?|feet|inches|pounds?|dollars?|euros?|cents?|usd|eur|percent)(?![\p{L}\p{N}])"
)
_NUMBER_WORDS = (
    r" (?=[tfsenhm])(two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|twenty|thirty|forty|fifty|hundred|thousand|million)(?= |$)"
)
_BETWEEN = rf"[^\p{{L}}\p{{N}}{MARKS}{POINT}%°]++"


def marked(text: Column, name: str = _NAME) -> Column:
    """The words of ``text``, one space apart; names, numbers and units begin with a mark.

    The words are the same whatever pattern ``name`` is; only marks of names differ.
    Numbers and units are only looked for in texts that hold a digit from 0 to 9.
    """
    plain = F.regexp_replace(text, "[" + MARKS + POINT + "\t\x0b\f\r]", " ")
    named = F.regexp_replace(plain, name, NAME + "$0")
    inner = F.regexp_replace(named, _INNER, POINT)
    units = F.regexp_replace(inner, _UNITS, "$1 " + UNIT + "$2")
    numbers = F.when(named.rlike("[0-9]"), F.regexp_replace(units, _NUMBER, NUMBER)).otherwise(named)
    words = F.concat(F.lit(" "), F.regexp_replace(numbers, _BETWEEN, " "))
    return F.trim(F.regexp_replace(words, _NUMBER_WORDS, " " + NUMBER + "$1"))


def template(marked_text: Column) -> Column:
    """The words of a marked text, lower-cased; of a marked word only its mark."""
    return F.lower(F.regexp_replace(marked_text, f"([{MARKS}])[^ ]*", "$1"))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def _plain(marked_text: Column) -> Column:
    """A marked text or word as it was, lower-cased."""
    return F.lower(F.translate(marked_text, MARKS, ""))


def _windows(codes: DataFrame, sizes: list[int]) -> DataFrame:
    """``(doc_id, at, window)`` of ``codes(doc_id, code, plain)``: the hashes of the windows of a
    template's words, and, where they hold a slot, those of the plain words.

    Positions are exploded and the words of a window are read by place, so that windows are hashed
    in generated code and no array is made for one. Nulls, behind a window's end, do not count in a hash.
    """
    kinds = F.array(*[F.struct(F.lit(n).alias("size"), F.lit(plain).alias("as_is")) for n in sizes for plain in (False, True)])
    placed = codes.select("doc_id", "code", "plain", F.posexplode("code").alias("at", "first"))
    sized = placed.select("*", F.inline(kinds)).where(F.col("at") + F.col("size") <= F.size("code"))

    def within(k: int, value: Column) -> Column:
        return value if k < sizes[0] else F.when(F.col("size") > k, value)

    def word(words: str, k: int) -> Column:
        return F.get(words, F.col("at") + k)

    ks = range(sizes[-1])
    slot = F.lit(False)
    for k in ks:
        slot = slot | F.coalesce(within(k, word("code", k) != word("plain", k)), F.lit(False))
    chosen = [within(k, F.when(F.col("as_is"), word("plain", k)).otherwise(word("code", k))) for k in ks]
    return sized.where(~F.col("as_is") | slot).select("doc_id", "at", F.xxhash64("size", *chosen).alias("window"))


def _codes(texts: DataFrame, id: str) -> DataFrame:
    """``(id, code, plain)``: hashes of the words of a template, and of those as they were. The words are taken apart once."""
    words = texts.select(id, F.split(F.lower(marked(F.col("text"), _CAPITALISED)), " ").alias("words"))

    def hashed(slot) -> Column:
        # Marks sort before all that a word can begin with.
        return F.transform("words", lambda w: F.xxhash64(F.when(w < POINT, slot(w)).otherwise(w)))

    return words.select(
        id, hashed(lambda w: F.substr(w, F.lit(1), F.lit(1))).alias("code"), hashed(lambda w: F.translate(w, MARKS, "")).alias("plain")
    )


def item_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(item_id, words, wpos, size, window, templated, tokens)`` of items that hold a word;
    ``templated`` windows are also matched by other fillings than the item's."""
    items = benchmark.where("text is not null and item_id is not null").select(
        "item_id", _words(marked(F.col("text"))).alias("tokens"), _words(marked(F.col("text"), _CAPITALISED)).alias("capitalised")
    ).where(F.size("tokens") > 0)
    kind = lambda t: F.when(t.rlike(f"^[{MARKS}]"), F.substr(t, F.lit(1), F.lit(1))).otherwise(F.lower(t))
    # What begins the item or a sentence is read as a name and as a word.
    begins = lambda p, i: (~p["token"].rlike(f"^[{MARKS}]")) & (F.startswith(p["capital"], F.lit(NAME)) | ((i == 0) & p["token"].rlike(r"^\p{L}")))
    readings = F.transform(
        F.zip_with("tokens", "capitalised", lambda t, c: F.struct(t.alias("token"), c.alias("capital"))),
        lambda p, i: F.transform(
            F.when(begins(p, i), F.array(F.lit(NAME), F.lower(p["token"]))).otherwise(F.array(kind(p["capital"]))), lambda w: F.xxhash64(w)
        ),
    )
    sized = items.select(
        "item_id", "tokens", F.size("tokens").alias("words"), F.least(F.size("tokens"), F.lit(window)).alias("size"),
        F.transform("tokens", kind).alias("template"), readings.alias("readings"),
        F.transform("tokens", lambda t: F.xxhash64(_plain(t))).alias("plain"),
    )
    placed = sized.select("*", F.explode(F.sequence(F.lit(0), F.col("words") - F.col("size"))).alias("wpos"))
    at = F.col("wpos") + 1
    literal = F.size(F.filter(F.slice("template", at, F.col("size")), lambda w: ~w.isin(*MARKS)))
    every = F.aggregate(
        F.slice("readings", at, F.col("size")),
        F.array(F.array().cast("array<bigint>")),
        lambda found, words: F.flatten(F.transform(found, lambda f: F.transform(words, lambda w: F.concat(f, F.array(w))))),
    )
    templated = (literal >= F.col("size") * MIN_LITERAL) & (F.col("words") >= MIN_WORDS)
    keys = F.concat(
        F.when(templated, every).otherwise(F.array().cast("array<array<bigint>>")),
        F.array(F.slice("plain", at, F.col("size"))),
    )
    return placed.select("*", templated.alias("templated"), F.explode(F.array_distinct(keys)).alias("key")).select(
        "item_id", "words", "wpos", "size", F.xxhash64("size", "key").alias("window"), "templated", "tokens"
    )


def _consistent(pairs: Column) -> Column:
    """Whether names map one to one and numbers and units each to one of their kind."""

    def kinds(mark: str) -> Column:
        return F.filter(pairs, lambda p: F.startswith(p["mine"], F.lit(mark)))

    def distinct(of: Column, side: str) -> Column:
        return F.size(F.array_distinct(F.transform(of, lambda p: p[side])))

    names, others = kinds(NAME), F.filter(pairs, lambda p: ~F.startswith(p["mine"], F.lit(NAME)))
    return (
        (distinct(names, "mine") == F.size(names))
        & (distinct(names, "its") == F.size(names))
        & (distinct(others, "its") == F.size(others))
    )


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_coverage: float = MIN_COVERAGE
) -> DataFrame:
    """``(doc_id, item_id, n_windows, coverage, exact)``: the items each document holds.

    ``exact`` says that all slots are filled as in the item. Null texts and rows without an
    id hold nothing, and null items match nothing; rows that share an id count as one
    document. Columns other than the id and the text are left aside.
    """
    items = kept(item_windows(benchmark, window), "items")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect()) or [window]
    n_windows = items.count()
    texts = docs.where("text is not null and doc_id is not null").select("doc_id", "text")
    windows = _windows(_codes(texts, "doc_id"), sizes)
    places = small(items.select("window", "item_id", "wpos", "words", "size"), n_windows, 64)
    shift = (F.col("at") - F.col("wpos")).alias("shift")
    runs = kept(
        windows.join(places, "window")
        .groupBy("doc_id", "item_id", shift, "words", "size")
        .agg(F.sort_array(F.collect_set("wpos")).alias("found")),
        "runs",
    )

    # The words each run covers: windows overlap, so a window adds what the next leaves over.
    # Coverage is taken over all words, and over those in windows that other fillings can match.
    def covered(found: str) -> Column:
        steps = F.transform(found, lambda w, i: F.least(F.coalesce(F.get(found, i + 1) - w, F.col("size")), F.col("size")))
        return F.aggregate(steps, F.lit(0), lambda total, s: total + s)

    with_runs = runs.select("doc_id").distinct()
    marked_docs = texts.join(small(with_runs, with_runs.count(), 16), "doc_id", "left_semi").select(
        "doc_id", _words(marked(F.col("text"))).alias("mine")
    )
    # The words in matched windows beside the item's; gaps between windows say nothing.
    base = F.get("found", F.lit(0))
    beside = F.filter(
        F.zip_with(
            F.slice("mine", F.col("shift") + base + 1, F.col("span")),
            F.slice("tokens", base + 1, F.col("span")),
            lambda mine, its: F.struct(mine.alias("mine"), its.alias("its")),
        ),
        lambda p, i: F.exists("found", lambda w: (w <= i + base) & (i + base < w + F.col("size"))),
    )
    slots = F.filter(
        "pairs",
        lambda p: p["mine"].rlike(f"^[{MARKS}]") & (F.substr(p["mine"], F.lit(1), F.lit(1)) == F.substr(p["its"], F.lit(1), F.lit(1))),
    )
    able = F.sort_array(F.collect_set(F.when(F.col("templated"), F.col("wpos")))).alias("able")
    tokens = small(items.groupBy("item_id").agg(F.first("tokens").alias("tokens"), able), n_windows, 1024)
    span = F.element_at("found", -1) - F.get("found", F.lit(0)) + F.col("size")
    judged = (
        runs.join(marked_docs, "doc_id")
        .join(tokens, "item_id")
        .withColumn("span", span)
        .select("doc_id", "item_id", "words", "size", "able", "found", F.array_distinct(beside).alias("pairs"))
        .where(_consistent(slots))
        .withColumn("exact", ~F.exists("pairs", lambda p: _plain(p["mine"]) != _plain(p["its"])))
    )
    # An item may lie in a text in several runs, where a slot has more words than in the item.
    return (
        judged.select("doc_id", "item_id", "words", "size", "able", "exact", F.explode("found").alias("wpos"))
        .groupBy("doc_id", "item_id", "words", "size", "able")
        .agg(F.sort_array(F.collect_set("wpos")).alias("found"), F.bool_and("exact").alias("exact"))
        .withColumn("templates", F.array_intersect("found", "able"))
        .select(
            "doc_id", "item_id", F.size("found").cast("long").alias("n_windows"),
            F.greatest(
                covered("found") / F.col("words"),
                F.when(F.size("able") > 0, covered("templates") / covered("able")).otherwise(0.0),
            ).alias("coverage"),
            "exact",
        )
        .where(F.col("coverage") >= min_coverage)
    )


def op7_template_decontamination(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
