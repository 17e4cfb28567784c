import pytest
from conftest import record
from pyspark.sql import functions as F

from dossierlens.operators import categories as cat
from dossierlens.plans import category_weights_of_dump, document_context, document_scores, run_context
from dossierlens.operators.index import build_index
from dossierlens.operators.pages import eligible_pages


def paged(spark, *lists):
    return spark.createDataFrame(
        [(i, c) for i, c in enumerate(lists)], "page_id long, categories array<string>"
    )


def test_weights_share_one_per_page(spark):
    pages = paged(spark, ["A", "A", "B"], ["B"])
    got = {r.category: r.weight for r in cat.category_weights(pages).collect()}
    assert got == pytest.approx({"A": 2 / 3, "B": 4 / 3})
    assert sum(got.values()) == pytest.approx(2)


def scores(spark, on_missing="error", weights=(("A", 0.5), ("B", 4.0))):
    hits = spark.createDataFrame([(7, 1, 3.0)], "q long, doc long, score double")
    pages = paged(spark, ["A", "B"])
    query_of_page = spark.createDataFrame([(0, 7)], "page_id long, q long")
    mass = cat.category_mass(query_of_page, pages, ["q"])
    weights = spark.createDataFrame(list(weights), "category string, weight double")
    found = cat.document_category_scores(hits, mass, weights, ["q"], "doc", on_missing)
    return {r.category: r.score for r in found.collect()}


def test_score_over_categories_and_weight(spark):
    assert scores(spark) == {"A": 3.0, "B": 0.375}


def test_missing_weights(spark):
    with pytest.raises(Exception, match="no weight for category: B"):
        scores(spark, weights=[("A", 0.5)])
    assert scores(spark, "drop", [("A", 0.5)]) == {"A": 3.0}
    with pytest.raises(ValueError):
        scores(spark, "ignore")


def test_top_ten_with_ties_by_name(spark):
    rows = [("f", f"C{i:02}", float(100 - i)) for i in range(8)]
    rows += [("f", "Y", 1.0), ("f", "X", 1.0), ("f", "Z", 1.0), ("f", "last", 0.5)]
    df = spark.createDataFrame(rows, "filename string, category string, score double")
    got = [r.category for r in cat.top_categories(df).orderBy("rank").collect()]
    assert got == [f"C{i:02}" for i in range(8)] + ["X", "Y"]
    assert cat.top_categories(df, 20).count() == 12


def test_render(spark):
    df = spark.createDataFrame(
        [("f", 2, "B", 1.0), ("f", 1, "A", 2.0), ("g", 1, "C", 1e-4)],
        "filename string, rank int, category string, score double",
    )
    got = {r.filename: r.rendered for r in cat.render_context(df).collect()}
    assert got == {"f": "A (2.0) / B (1.0)", "g": "C (1.0E-4)"}


FILL = " filler" * 300


@pytest.fixture
def inputs(tmp_path):
    folder = tmp_path / "case"
    folder.mkdir()
    for i in range(6):
        (folder / f"{i}.txt").write_text(f"treaties about fishing number{i}")
        (folder / f"b{i}.txt").write_text("budget hearings")
    pages = [
        record("Fish", "fishing treaty fishing treaty [[Category:Sea]] [[Category:Law]]" + FILL),
        record("Money", "budgets budget hearing hearing [[Category:Money]] [[Category:Law]]" + FILL),
        record("Other", "nothing nothing [[Category:Other]]" + FILL),
    ]
    (tmp_path / "dump.xml").write_text("<mediawiki>" + "".join(pages) + "\n</mediawiki>")
    return str(tmp_path / "dump.xml"), str(folder), str(tmp_path / "out")


def test_whole_run(spark, inputs):
    dump, folder, out = inputs
    rows = run_context(spark, dump, folder, out).collect()
    by_file = {}
    for r in sorted(rows, key=lambda r: (r.filename, r.rank)):
        by_file.setdefault(r.filename, []).append(r.category)
    assert by_file == {f"case/{i}.txt": ["SEA", "LAW"] for i in range(6)} | {
        f"case/b{i}.txt": ["MONEY", "LAW"] for i in range(6)
    }
    lines = sorted(r.value for r in spark.read.text(f"{out}/context").collect())
    assert len(lines) == 12 and lines[0].startswith("case/0.txt\tSEA (")
    weights = dict(r.value.split("\t") for r in spark.read.text(f"{out}/weights").collect())
    assert weights == {"SEA": "0.5", "LAW": "1.0", "MONEY": "0.5", "OTHER": "1.0"}
    assert {r.category: r.weight for r in category_weights_of_dump(spark, dump).collect()} == {
        c: float(w) for c, w in weights.items()
    }


def test_second_run_reuses_tables_and_replaces_the_context(spark, inputs, tmp_path):
    import os

    dump, folder, out = inputs

    def stamp(name):
        return sorted((e.name, e.stat().st_mtime_ns) for e in os.scandir(f"{out}/{name}"))

    first = run_context(spark, dump, folder, out).collect()
    kept, replaced = [stamp("pages"), stamp("weights.parquet")], stamp("context.parquet")
    second = run_context(spark, dump, folder, out).collect()
    assert sorted(first) == sorted(second)
    assert [stamp("pages"), stamp("weights.parquet")] == kept
    assert stamp("context.parquet") != replaced


def test_runs_take_texts_apart_once(spark, inputs, monkeypatch):
    """Pages are kept as counts; the second run reads no text, and other rules for words make the pages anew."""
    import os

    from dossierlens.operators import index, similar, terms

    dump, folder, out = inputs
    data = lambda: [f"{out}/pages/{f}" for f in os.listdir(f"{out}/pages") if f.startswith("made-")]
    first = run_context(spark, dump, folder, out, stem=False).collect()
    kept = data()
    assert "body" not in spark.read.parquet(*kept).columns
    with monkeypatch.context() as patched:
        for module, name in ((similar, "words"), (similar, "term_counts"), (terms, "words"), (index, "words")):
            patched.setattr(module, name, lambda *_, **__: pytest.fail("a text was taken apart again"))
        assert sorted(run_context(spark, dump, folder, out, stem=False).collect()) == sorted(first)
    assert data() == kept
    found = run_context(spark, dump, folder, out, stem=False, search_options={"max_words": 2, "min_term_freq": 1}).collect()
    assert sorted(found) != sorted(first) and data() != kept


def test_command_line(spark, inputs, tmp_path):
    from dossierlens.__main__ import main

    dump, folder, out = inputs
    main([dump, folder, out, "-n", "1", "--no-stem"])
    assert all(" / " not in r.value for r in spark.read.text(f"{out}/context").collect())
    with pytest.raises(Exception):
        main([str(tmp_path / "absent.xml"), folder, str(tmp_path / "other")])


def test_context_takes_the_best_of_all_scores(spark, inputs):
    docs = spark.createDataFrame([(f"d{i}", "fish law fish") for i in range(6)], "filename string, text string")
    values = [(i, record("t", f"fish fish [[Category:C{i % 4}]] [[Category:D]]" + FILL)) for i in range(9)]
    pages = eligible_pages(spark.createDataFrame(values, "page_id long, value string"))
    weights = cat.category_weights(pages)
    index = build_index(docs, stem=False)
    every = document_scores(pages, index, weights)
    assert every.count() == 6 * 5
    best = document_context(pages, index, weights, n=2)
    assert best.count() == 12 and best.where("rank = 1 and category != 'D'").count() == 6 - best.where(
        "rank = 1 and category = 'D'"
    ).count()
    # One hit score for all pages here: a category's pages times 1/2, over its weight.
    one = every.select(F.round("score", 9).alias("s")).distinct().count()
    assert one == 1
