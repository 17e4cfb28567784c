import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dossierlens.operators import similar
from dossierlens.operators.index import build_index, doc_stats, postings, term_stats
from dossierlens.operators.terms import counted_pages
from dossierlens.plans import page_similarity
from dossierlens.sources import scratch_path


def f32(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def brute_force(pages, docs, k=20, max_words=None, min_tf=2, min_df=5, max_terms=25):
    """Every page against every document, straight from the formulas."""
    counts = {name: Counter(text.split()) for name, text in docs.items()}
    df = Counter(t for c in counts.values() for t in c)
    idf = {t: math.log(len(docs) / (n + 1)) + 1 for t, n in df.items()}
    result = {}
    for page, body in pages.items():
        tf = Counter(body.split()[:max_words])
        terms = [t for t, n in tf.items() if n >= min_tf and df.get(t, 0) >= min_df]
        terms = sorted(terms, key=lambda t: (-f32(tf[t] * idf[t]), t))[:max_terms]
        if not terms:
            continue
        norm = 1 / math.sqrt(sum(idf[t] ** 2 for t in terms))
        scores = {}
        for name, c in counts.items():
            matched = [t for t in terms if t in c]
            if matched:
                total = sum(math.sqrt(c[t]) * idf[t] ** 2 / math.sqrt(sum(c.values())) for t in matched)
                scores[name] = len(matched) / len(terms) * norm * total
        best = sorted(scores, key=lambda n: (-f32(scores[n]), n))[:k]
        result[page] = [(n, round(scores[n], 9)) for n in best]
    return result


def collected(rows):
    found = {}
    for r in rows.orderBy("page_id", "rank").collect():
        found.setdefault(r.page_id, []).append((r.filename, round(r.score, 9)))
        assert r.rank == len(found[r.page_id])
    return found


def indexed(spark, docs, **options):
    rows = spark.createDataFrame(list(docs.items()), "filename string, text string")
    return build_index(rows, stem=False, **options)


def asked(spark, pages, index, k=20, **choice):
    rows = spark.createDataFrame(
        [(p, f"title {p}", b) for p, b in pages.items()], "page_id long, title string, body string"
    )
    return collected(page_similarity(rows, index, k, **choice))


def run(spark, pages, docs, k=20, head_size=1024, shard_entries=10**6):
    return asked(spark, pages, indexed(spark, docs, head_size=head_size, shard_entries=shard_entries), k)


def corpus(seed, n_docs=120, n_pages=25, vocabulary=60):
    """Texts with a few very common words, of very different lengths, some of them copies."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    odds = [1 / (i + 1) for i in range(vocabulary)]

    def text(longest):
        return " ".join(rng.choices(words, odds, k=rng.randrange(1, longest)))

    docs = {f"d{i:03}": text(rng.choice([4, 30, 200])) for i in range(n_docs)}
    for i in range(0, n_docs, 3):
        docs[f"d{i:03}"] = docs["d001"]
    pages = {i: text(rng.choice([10, 300])) for i in range(n_pages)}
    for i in range(0, n_pages, 3):
        pages[i] = pages[1]
    return pages, docs


@pytest.mark.parametrize("head_size, k", [(1, 3), (8, 20), (40, 3), (1024, 20)])
def test_same_as_brute_force(spark, head_size, k):
    pages, docs = corpus(head_size)
    assert run(spark, pages, docs, k, head_size) == brute_force(pages, docs, k)


def test_same_with_several_shards(spark):
    pages, docs = corpus(4)
    assert run(spark, pages, docs, 20, 1024, shard_entries=700) == brute_force(pages, docs)
    assert run(spark, pages, docs, 20, 8, shard_entries=1000) == brute_force(pages, docs)


def test_same_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(similar, "BROADCAST_BYTES", -1)
    pages, docs = corpus(5)
    assert run(spark, pages, docs, 20, 16) == brute_force(pages, docs)


def test_tails_stay_closed_where_they_cannot_matter(spark):
    # A word of all documents, with a long flat tail, next to a rare one.
    docs = {f"d{i:03}": f"the own{i} " + " ".join(f"x{j}" for j in range(30)) for i in range(200)}
    docs |= {f"r{i}": f"rare the own{i}" for i in range(10)}
    pages = {0: "rare rare the the"}
    index = indexed(spark, docs, head_size=16)
    assert asked(spark, pages, index, 5) == brute_force(pages, docs, 5)
    # Each of the 31 common words leaves its 200 documents in the tail.
    assert index.n_tails == 31 and index.tails.where("term = 'the'").count() == 200
    page_rows = spark.createDataFrame([(0, pages[0])], "page_id long, body string")
    queries = similar.page_queries(similar.query_terms(page_rows, index))
    scored = similar._sums_with_tails(queries.drop("page_id"), 1, index, 5)
    assert scored.count() == 10, "no document with the common word alone was paired"


def test_more_shards_do_not_mean_longer_heads(spark):
    """Heads are limited over all shards, so a word of all documents has a tail however many
    shards there are, and its tail stays closed where it cannot matter."""
    docs = {f"d{i:03}": f"the own{i} " + " ".join(f"x{j}" for j in range(30)) for i in range(200)}
    docs |= {f"r{i}": f"rare the own{i}" for i in range(10)}
    pages = {0: "rare rare the the"}
    index = indexed(spark, docs, head_size=16, shard_entries=1000)
    assert index.n_shards > 4 and index.n_tails == 31
    assert index.tails.where("term = 'the'").count() == 200
    assert asked(spark, pages, index, 5) == brute_force(pages, docs, 5)
    one_shard = index.tails.where("shard = 1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in one_shard


def test_building_an_index_moves_no_text_and_joins_no_posting(spark):
    from dossierlens.functions.scoring import length_norm
    from dossierlens.operators import index as idx

    docs = spark.createDataFrame([(f"d{i}", f"text number {i}") for i in range(20)], "filename string, text string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    counted = idx._counted(docs, False)
    assert "Exchange" not in plan(counted)
    contents = idx._contents(idx._numbered(counted, counted.select("row", "row").toDF("row", "file_no")), False)
    stored = scratch_path(spark, "contents")
    contents.write.parquet(stored)
    entries = idx._entries(spark.read.parquet(stored), length_norm, 3)
    assert "Join" not in plan(entries) and "Exchange" not in plan(entries)
    assert "Join" not in plan(idx._packed(entries))
    index = build_index(docs, stem=False)
    assert [r.filename for r in index.files.orderBy("file_no").collect()] == sorted(f"d{i}" for i in range(20))


def page_queries(spark, pages, index):
    rows = spark.createDataFrame(list(pages.items()), "page_id long, body string")
    path = scratch_path(spark, "asked")
    similar.page_queries(similar.query_terms(rows, index)).write.parquet(path)
    return spark.read.parquet(path)


def test_all_shards_are_scored_in_one_job(spark):
    """The jobs do not grow with the shards, and pairs are summed in the task that makes them."""
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    pages, docs = corpus(7)
    jobs, plans = [], []
    for shard_entries in (400, 20):
        index = indexed(spark, docs, shard_entries=shard_entries)
        queries = page_queries(spark, pages, index)
        spark.sparkContext.setJobGroup(f"shards-{shard_entries}", "")
        found = similar.query_hits(queries, index)
        jobs.append((index.n_shards, len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"shards-{shard_entries}"))))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert found.count() > 0
        spark.conf.set(threshold, "-1")
        with similar._dealt_by_tile(spark):
            distinct = queries.select(*similar.QUERY, "terms", "squares", "scale").dropDuplicates(similar.QUERY)
            sums = similar._head_sums(similar._in_shards(distinct, index), 100, index, ["scale"])
            plans.append(sums._jdf.queryExecution().executedPlan().toString())
        spark.conf.set(threshold, before)
    (few, jobs_of_few), (many, jobs_of_many) = jobs
    assert 1 < few < 5 and many > 50
    assert jobs_of_many == jobs_of_few
    for plan in plans:
        assert plan.count("REPARTITION_BY_NUM") == 2
        # Behind the join there is no exchange: the only other one makes queries distinct.
        assert plan.count("Exchange") == 3, plan


def test_heads_of_all_shards_keep_more_tails_closed_than_those_of_one(spark, monkeypatch):
    """The bound each query gets from all shards is no lower than that of a single shard."""
    rng = random.Random(3)
    docs = {f"d{i:03}": " ".join(["the", "of", *(f"x{rng.randrange(30)}" for _ in range(rng.choice([3, 60])))]) for i in range(400)}
    docs |= {f"r{i}": f"rare the own{i}" for i in range(12)}
    pages = {0: "rare rare the the of of", 1: "x1 x1 x2 x2 the the"}
    index = indexed(spark, docs, head_size=24, shard_entries=1500)
    assert index.n_shards > 4
    tables, real = {}, similar.materialize
    monkeypatch.setattr(similar, "materialize", lambda s, compute, path, *rest: tables.setdefault(path.rsplit("/", 1)[-1].split("-")[0], real(s, compute, path, *rest)))
    assert asked(spark, pages, index, 5) == brute_force(pages, docs, 5)
    monkeypatch.undo()
    opened = F.sum(F.size("tails") - F.col("n_closed"))
    everywhere = tables["decided"].agg(opened).first()[0]
    by_shard = 0
    for shard in range(index.n_shards):
        here = F.col("shard") == shard
        decided = similar._decided(tables["bounded"].where(here), similar._needed(tables["found"].where(here), 5))
        by_shard += decided.agg(opened).first()[0]
    assert everywhere < by_shard


def test_defaults_and_options(spark):
    docs = {f"d{i}": "common shared " + ("seldom" if i < 4 else "often") for i in range(12)}
    index = indexed(spark, docs)
    late = "x " * 5000 + "common common"
    both = "common common often often"
    pages = {1: "seldom seldom", 2: "often", 3: "common common often", 4: late, 5: both}
    found = asked(spark, pages, index)
    assert 1 not in found, "four documents are too few"
    assert 2 not in found, "one occurrence is too few"
    assert len(found[4]) == 12, "the whole text is looked at"
    assert (len(found[3]), len(found[5])) == (12, 12)
    assert 4 not in asked(spark, {4: late}, index, max_words=5000), "unless the caller wants only its beginning"
    assert len(asked(spark, {5: both}, index, max_doc_freq=8)[5]) == 8
    assert asked(spark, {5: both}, index, 2, max_terms=1) == brute_force({5: both}, docs, 2, max_terms=1)


def test_stemmed_words_meet(spark):
    docs = spark.createDataFrame([(f"d{i}", "running cats") for i in range(6)], "filename string, text string")
    pages = spark.createDataFrame([(1, "t", "the cat runs, a cat ran")], "page_id long, title string, body string")
    index = build_index(docs)
    terms = {r.term: (r.tf, round(r.weight, 6)) for r in similar.query_terms(pages, index).collect()}
    assert terms == {"cat": (2, round(2 * (math.log(6 / 7) + 1), 6))}
    assert page_similarity(pages, index).count() == 6


def test_byte_norm(spark):
    docs = {f"d{i}": "a b c d e f g h i j" for i in range(5)}
    rows = spark.createDataFrame(list(docs.items()), "filename string, text string")
    pages = spark.createDataFrame([(1, "t", "a a")], "page_id long, title string, body string")
    exact, cut = (page_similarity(pages, build_index(rows, stem=False, norm=n)).first().score for n in ("exact", "byte"))
    assert cut / exact == pytest.approx(0.3125 / math.sqrt(0.1))


def test_plain_tables(spark):
    docs = spark.createDataFrame([("a", "x y x"), ("b", "X z"), ("c", "")], "filename string, text string")
    assert {tuple(r) for r in postings(docs).collect()} == {("x", "a", 2), ("y", "a", 1), ("x", "b", 1), ("z", "b", 1)}
    assert {tuple(r) for r in doc_stats(docs).collect()} == {("a", 3), ("b", 2), ("c", 0)}
    stats = {r.term: (r.df, r.idf) for r in term_stats(docs).collect()}
    assert stats == {"x": (2, 1.0), "y": (1, math.log(1.5) + 1), "z": (1, math.log(1.5) + 1)}


def test_documents_without_words_count(spark):
    docs = {f"d{i}": "word" for i in range(6)} | {f"e{i}": "" for i in range(4)}
    assert run(spark, {1: "word word"}, docs) == brute_force({1: "word word"}, docs)


def test_an_index_is_reused_for_its_own_settings_only(spark):
    path = scratch_path(spark, "kept")
    few = spark.createDataFrame([("a", "x")], "filename string, text string")
    more = spark.createDataFrame([("a", "x"), ("b", "y")], "filename string, text string")
    assert build_index(few, path, stem=False).n_files == 1
    assert build_index(more, path, stem=False).n_files == 1
    assert build_index(more, path, stem=True).n_files == 2
    assert build_index(more, path, stem=False, if_exists="overwrite").n_files == 2


def test_an_index_for_other_documents_is_made_anew(spark):
    path = scratch_path(spark, "kept")
    few = spark.createDataFrame([("a", "x")], "filename string, text string")
    more = spark.createDataFrame([("a", "x"), ("b", "y")], "filename string, text string")
    assert build_index(few, path, fingerprint="few").n_files == 1
    assert build_index(more, path, fingerprint="few").n_files == 1
    assert build_index(more, path, fingerprint="more").n_files == 2


@pytest.mark.parametrize("stem", [False, True])
def test_files_of_one_name_are_two_documents(spark, stem):
    docs = spark.createDataFrame([("same", "alpha beta"), ("same", "gamma"), ("other", "gamma")], "filename string, text string")
    index = build_index(docs, stem=stem)
    assert index.n_files == 3
    assert {r.term: r.df for r in index.terms.collect()} == {t: n for t, n in zip([r.term for r in index.terms.orderBy("term").collect()], (1, 1, 2))}


def test_partitioning_does_not_change_the_result(spark):
    pages, docs = corpus(11)
    rows = spark.createDataFrame(list(docs.items()), "filename string, text string")
    page_rows = spark.createDataFrame([(p, "t", b) for p, b in pages.items()], "page_id long, title string, body string")
    found = [
        collected(page_similarity(page_rows.repartition(n), build_index(rows.repartition(n), stem=False)))
        for n in (1, 7)
    ]
    assert found[0] == found[1]
    assert max(map(len, found[0].values())) <= 20


@pytest.mark.parametrize("stem, choice", [(False, {}), (True, {}), (False, {"max_words": 9, "min_term_freq": 1}), (True, {"max_words": 12, "min_term_freq": 3})])
def test_counts_ask_as_texts_do(spark, stem, choice):
    """Pages kept as counts hold no text, and ask with the same terms; a stem's words are summed before rare ones go."""
    texts = [(1, "treaty treaties fish fishing fished o'neil o'neil"), (2, "fish law law state's state's law U.S. u.s."), (3, None), (4, "")]
    pages = spark.createDataFrame(texts, "page_id long, body string").withColumn("title", F.lit("t"))
    docs = spark.createDataFrame([(f"d{i}", "treaty fish law state us o'neil") for i in range(6)], "filename string, text string")
    index = build_index(docs, stem=stem)
    kept = counted_pages(pages, stem=stem, **choice)
    assert kept.columns == ["page_id", "counts", "title"]
    found, expected = (sorted(map(tuple, similar.query_terms(p, index, **choice).collect())) for p in (kept, pages))
    assert found == expected and {row[0] for row in found} == {1, 2}


@pytest.mark.parametrize("stem", [False, True])
def test_terms_are_chosen_in_the_row_of_a_page(spark, monkeypatch, stem):
    """Words of pages are not moved to be chosen; the same rows as by the join, where ids repeat or are null too."""
    rng = random.Random(5)
    said = ["run", "runs", "running", "cats", "cat", "flies", "fly", "été", "the", "zzz", "über"]
    docs = spark.createDataFrame([(f"d{i}", " ".join(rng.choice(said[:-2]) for _ in range(9))) for i in range(60)], "filename string, text string")
    texts = [(i, " ".join(rng.choice(said) for _ in range(rng.randrange(1, 40)))) for i in range(40)]
    texts += [texts[0], (1, "runs runs fly"), (None, "cat cat the"), (None, "cat fly fly"), (77, None), (78, "")]
    index = build_index(docs, stem=stem)

    def chosen(rows):
        pages = spark.createDataFrame(rows, "page_id long, body string")
        found = similar.query_terms(pages, index, max_terms=4)
        return found._jdf.queryExecution().optimizedPlan().toString(), sorted(map(repr, found.collect()))

    plan, alone = chosen(texts[2:40])
    assert not stem or "MapInArrow" in plan and "Join" not in plan and "Window" not in plan
    every = chosen(texts)[1]
    monkeypatch.setattr(similar, "LEXICON_BYTES", 0)
    joined, rows = chosen(texts)
    assert "Join" in joined and rows == every != []
    assert chosen(texts[2:40])[1] == alone != []


def test_hits_are_not_moved_to_meet_titles(spark):
    index = build_index(spark.createDataFrame([(f"d{i}", "a a b") for i in range(9)], "filename string, text string"), stem=False)
    pages = spark.createDataFrame([(1, "t", "a a b b")], "page_id long, title string, body string")
    plan = page_similarity(pages, index)._jdf.queryExecution().optimizedPlan().toString()
    top = next(line for line in plan.splitlines() if "Join" in line)
    assert "query_a" in top and "page_id" not in top
