import bz2
import gzip
import os
import random

import pytest
from conftest import record

from dossierlens.functions.markup import TEXT_CLOSE, TEXT_OPEN, extract_between
from dossierlens.sources import (
    is_complete,
    materialize,
    read_case_documents,
    read_delimited,
    read_weights,
    read_wiki_pages,
    scratch_path,
    write_context,
    write_weights,
)


def values(df):
    return sorted(r.value for r in df.collect())


def write(path, text):
    path.write_bytes(text.encode())
    return str(path)


def test_delimited_records_keep_their_marks(spark, tmp_path):
    path = write(tmp_path / "f", "pre{a} between {b\n}{c} after {unfinished")
    assert values(read_delimited(spark, path, "{", "}")) == ["{a}", "{b\n}", "{c}"]


def test_delimited_anchor_end_keeps_nested_start_marks(spark, tmp_path):
    path = write(tmp_path / "f", "pre} x{a{b} {c} after")
    assert values(read_delimited(spark, path, "{", "}", anchor="end")) == ["{a{b}", "{c}"]
    assert values(read_delimited(spark, path, "{", "}")) == ["{a{b}", "{c}"]
    assert values(read_delimited(spark, path, "{", "}", anchor="start")) == ["{b}", "{c}", "{pre}"]


def test_delimited_preamble_nested_marks_and_open_tails(spark, tmp_path):
    text = "junk <z> tail <a>one<z> <a>two<a>three<z>"
    path = write(tmp_path / "f", text)
    assert values(read_delimited(spark, path, "<a>", "<z>")) == ["<a>one<z>", "<a>two<a>three<z>"]
    left_open = write(tmp_path / "g", "<a>four<z><a>five")
    assert values(read_delimited(spark, left_open, "<a>", "<z>")) == ["<a>four<z>"]
    both = values(read_delimited(spark, [path, left_open], "<a>", "<z>"))
    assert both == ["<a>four<z>", "<a>one<z>", "<a>two<a>three<z>"]
    packed = tmp_path / "h.bz2"
    packed.write_bytes(bz2.compress(b"<a>six<z><a>seven"))
    assert values(read_delimited(spark, str(packed), "<a>", "<z>")) == ["<a>six<z>"]


def read_by_hand(data, start, end, max_bytes=None):
    """One file from its first byte to its last."""
    records, at = [], 0
    while (begin := data.find(start, at)) >= 0:
        close = data.find(end, begin + len(start))
        size = close + len(end) - begin
        if max_bytes is not None and (close < 0 or size > max_bytes):
            at = begin + max_bytes + 1
        elif close < 0:
            break
        else:
            records.append(data[begin : close + len(end)].decode())
            at = close + len(end)
    return sorted(records)


PACKED = {"": lambda data: data, ".bz2": lambda data: bz2.compress(data, 1), ".gz": gzip.compress}


@pytest.fixture
def split_size(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", n)
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("packing", PACKED)
@pytest.mark.parametrize("split", [1024, 128 << 20])
def test_records_are_the_same_in_any_packing_and_split(spark, tmp_path, split_size, packing, split):
    rng = random.Random(5)
    split_size(split)
    folder = tmp_path / "a b%20+é"
    folder.mkdir()
    expected, short = [], []
    tails = [b"", b"<a>open", b"<a>open <a>again", b"\n", b"<z>", b"<a>whole<z>", b"<a>" + b"x" * 5000, b"gap" * 2000]
    for k, tail in enumerate(tails):
        parts = [rng.choice([b"<a>", b"<a>", b"<z>", b"<z>", "é".encode() * rng.randint(0, 400), b"text", b"<", b"a>", b"<<a"]) for _ in range(300)]
        data = (b"" if k % 3 else b"junk <z> tail ") + b"".join(parts) + tail
        (folder / f"f{k}{packing}").write_bytes(PACKED[packing](data))
        expected += read_by_hand(data, b"<a>", b"<z>")
        short += read_by_hand(data, b"<a>", b"<z>", 300)
    assert values(read_delimited(spark, str(folder), "<a>", "<z>")) == sorted(expected)
    assert values(read_delimited(spark, str(folder), "<a>", "<z>", max_bytes=300)) == sorted(short)


def test_mixed_files_and_splits_of_one_packed_file(spark, tmp_path, split_size):
    rng = random.Random(6)
    data = b"<z>" + b"".join(b"<a>" + rng.randbytes(3000).hex().encode() + b"<a><z>" for _ in range(400)) + b"<a>open"
    for packing, pack in PACKED.items():
        (tmp_path / f"f{packing}").write_bytes(pack(data))
    split_size(100_000)
    found = read_delimited(spark, str(tmp_path), "<a>", "<z>")
    assert values(found) == sorted(3 * read_by_hand(data, b"<a>", b"<z>"))
    one = spark.read.option("lineSep", "<z>").text(str(tmp_path / "f.bz2"))
    assert one.rdd.getNumPartitions() > 5


def test_many_files_are_looked_at_in_one_job(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"f{k}").write_bytes(b"<a>%d<z>" % k + b"<a>open" * (k % 2))
    spark.sparkContext.setJobGroup("many files", "many files")
    found = read_delimited(spark, str(tmp_path), "<a>", "<z>")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("many files"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 20
    assert values(found) == sorted(f"<a>{k}<z>" for k in range(300))


def test_records_beside_long_gaps_and_open_records_are_kept(spark, tmp_path):
    gap = "-" * (2 << 20)
    path = write(tmp_path / "f", gap + "{aa}" + gap + "{bb}" + gap + "{" + "c" * (40 << 20) + "{dd}" + gap)
    assert values(read_delimited(spark, path, "{", "}", max_bytes=6)) == ["{aa}", "{bb}", "{dd}"]


def test_an_oversize_record_is_forgotten_and_the_next_start_mark_counts(spark, tmp_path):
    path = write(tmp_path / "f", "{ééééé{x}{ab{cd}{{{{{{{e}")
    for most in range(2, 16):
        expected = read_by_hand((tmp_path / "f").read_bytes(), b"{", b"}", most)
        assert values(read_delimited(spark, path, "{", "}", max_bytes=most)) == expected, most


def test_delimited_rejects_bad_arguments(spark, tmp_path):
    with pytest.raises(ValueError):
        read_delimited(spark, str(tmp_path), "", "}")
    with pytest.raises(ValueError):
        read_delimited(spark, str(tmp_path), "{", "}", anchor="middle")
    for marks in (("ab", "bc"), ("a", "a"), ("<a>", "<a>>"), ("xx", "x")):
        with pytest.raises(ValueError, match="overlap"):
            read_delimited(spark, str(tmp_path), *marks)


def test_oversize_records_are_dropped_and_reading_goes_on(spark, tmp_path):
    path = write(tmp_path / "f", "{aa}{" + "b" * 50 + "}{éé}")
    assert values(read_delimited(spark, path, "{", "}", max_bytes=6)) == ["{aa}", "{éé}"]
    assert values(read_delimited(spark, path, "{", "}", max_bytes=5)) == ["{aa}"]


@pytest.fixture
def dump():
    pages = [record(f"page {i}", f"body {i} " + "é" * (i % 90)) for i in range(3000)]
    text = "<mediawiki>\n  <siteinfo>x</siteinfo>" + "".join(pages)
    return pages, text + record("unfinished", "x")[:-12]


@pytest.mark.parametrize("split", [4096, 50_000, 128 << 20])
@pytest.mark.parametrize("packed", [False, True])
def test_wiki_pages_do_not_depend_on_splits(spark, tmp_path, dump, split, packed):
    pages, text = dump
    if packed:
        path = str(tmp_path / "dump.xml.bz2")
        with open(path, "wb") as out:
            out.write(bz2.compress(text.encode(), 1))
    else:
        path = write(tmp_path / "dump.xml", text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        assert values(read_wiki_pages(spark, path)) == sorted(pages)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_bodies_of_the_last_revision_win(spark, tmp_path):
    block = "\n      " + TEXT_OPEN + "{}" + TEXT_CLOSE
    two = (
        "\n  <page>\n    <title>T</title>\n    <revision><id>1</id>" + block.format("old")
        + "\n    </revision>\n    <revision><id>2</id>" + block.format("new") + "\n    </revision>\n  </page>"
    )
    path = write(tmp_path / "dump.xml", "<mediawiki>" + two + record("plain", "p") + "\n</mediawiki>")
    rows = read_wiki_pages(spark, path)
    got = {r.value: r.body for r in rows.withColumn("body", extract_between(rows.value, TEXT_OPEN, TEXT_CLOSE)).collect()}
    assert sorted(got.values()) == ["new", "p"]
    moved = next(v for v, b in got.items() if b == "new")
    assert "<id>1</id>" in moved and "<id>2</id>" in moved and "old" not in moved
    assert moved.endswith(block.format("new") + "\n  </page>")


def test_case_documents(spark, tmp_path):
    folder = tmp_path / "case"
    (folder / "sub").mkdir(parents=True)
    (folder / "part=1").mkdir()
    write(folder / "one.txt", "line\n\nline")
    write(folder / "two + two%20é.txt", "x")
    write(folder / ".hidden", "h")
    write(folder / "empty", "")
    write(folder / "sub" / "inner.txt", "i")
    write(folder / "part=1" / "inner.txt", "i")
    (folder / "case").mkdir()
    write(folder / "case" / "inner.txt", "i")
    nested = folder / str(folder).lstrip("/")
    nested.mkdir(parents=True)
    write(nested / "inner.txt", "i")
    got = {r.filename: r.text for r in read_case_documents(spark, str(folder) + "/").collect()}
    assert got == {"case/one.txt": "line\n\nline", "case/two + two%20é.txt": "x"}


def test_weights_survive_a_round_trip(spark, tmp_path):
    rows = [("", 1.5), ('with "quotes"', 1e-7), ("A, B|KEY", 12345678.9)]
    df = spark.createDataFrame(rows, "category string, weight double").repartition(3)
    write_weights(df, str(tmp_path / "w"))
    assert sorted(tuple(r) for r in read_weights(spark, str(tmp_path / "w")).collect()) == sorted(rows)
    with pytest.raises(Exception, match="already exists"):
        write_weights(df, str(tmp_path / "w"))


def test_results_can_be_written_in_order(spark, tmp_path):
    df = spark.createDataFrame([(c, 1.0) for c in "CABED"], "category string, weight double").repartition(5)
    write_weights(df, str(tmp_path / "w"), order_by=["category"])
    parts = sorted((tmp_path / "w").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == "A\t1.0\nB\t1.0\nC\t1.0\nD\t1.0\nE\t1.0\n"


def test_an_empty_folder_has_no_documents(spark, tmp_path):
    assert read_case_documents(spark, str(tmp_path)).count() == 0


def test_context_sink_replaces(spark, tmp_path):
    path = str(tmp_path / "c")
    for text in ("old", "new"):
        write_context(spark.createDataFrame([("f", text)], "filename string, rendered string"), path)
    assert [r.value for r in spark.read.text(path).collect()] == ["f\tnew"]


def test_materialize(spark, tmp_path):
    path = str(tmp_path / "t")
    count = lambda n: materialize(spark, lambda: spark.range(n), path).count()
    assert (count(3), count(5)) == (3, 3)
    os.remove(os.path.join(path, "_SUCCESS"))
    assert not is_complete(spark, path)
    assert count(5) == 5
    assert materialize(spark, lambda: spark.range(7), path, "overwrite").count() == 7
    with pytest.raises(ValueError):
        materialize(spark, lambda: spark.range(1), path, "append")


def test_a_lost_run_leaves_the_former_table(spark, tmp_path, monkeypatch):
    """The second run ends after its data and before its manifest; the third one asks for the first inputs again."""
    from dossierlens.sources import stored

    path = str(tmp_path / "t")
    made = []

    def kept(n, fingerprint):
        return materialize(spark, lambda: made.append(n) or spark.range(n), path, fingerprint=fingerprint).count()

    assert kept(1, "A") == 1
    real = stored.MANIFEST
    monkeypatch.setattr(stored, "_drop_others", lambda *_: None)
    monkeypatch.setattr(stored, "MANIFEST", "no such folder/\0")  # the write of the manifest fails
    with pytest.raises(Exception):
        kept(5, "B")
    monkeypatch.undo()
    assert stored.MANIFEST == real
    assert len([f for f in os.listdir(path) if f.startswith("made-")]) == 2
    assert (kept(1, "A"), made) == (1, [1, 5])
    assert (kept(5, "B"), made) == (5, [1, 5, 5])
    assert len([f for f in os.listdir(path) if f.startswith("made-")]) == 1
    assert (kept(1, "A"), made) == (1, [1, 5, 5, 1])
    # Data whose own job did not end are not taken either.
    (data,) = [f for f in os.listdir(path) if f.startswith("made-")]
    os.remove(os.path.join(path, data, "_SUCCESS"))
    assert (kept(2, "A"), made) == (2, [1, 5, 5, 1, 2])


def test_a_record_far_above_the_limit_is_passed_over(spark, tmp_path):
    path = write(tmp_path / "f", "{aa}{" + "b" * 200_000 + "}{cc}")
    assert values(read_delimited(spark, path, "{", "}", max_bytes=6)) == ["{aa}", "{cc}"]


def test_scratch_lies_in_the_checkpoint_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    one, two = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert one.startswith(base) and one != two


def test_the_command_line_reads_present_day_dumps(spark, tmp_path, monkeypatch):
    """Marks with attributes, options from the command line, added documents, nothing left behind."""
    from dossierlens import __main__ as command
    from dossierlens import session

    def page(i):
        body = f"alpha beta alpha beta word{i} " + "x " * 1100 + f"[[Category:C{i % 2}]]"
        return f'\n  <page>\n    <title>T{i}</title>\n    <revision>\n      <text bytes="9" xml:space="preserve">{body}</text>\n    </revision>\n  </page>'

    (tmp_path / "cases").mkdir()
    for i in range(6):
        write(tmp_path / "cases" / f"{i}.txt", f"alpha beta {i}")
    dump = write(tmp_path / "dump.xml", "<mediawiki>" + "".join(map(page, range(4))) + "\n</mediawiki>\n")
    monkeypatch.setattr(command, "session", lambda **_: spark)
    monkeypatch.setattr(session, "BYTES_PER_SHUFFLE_PARTITION", 2000)
    out = str(tmp_path / "out")
    arguments = [dump, str(tmp_path / "cases"), out, "--text-pattern", "<text [^>]*>", "--on-missing", "drop", "-n", "3"]
    setting = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    try:
        command.main(arguments)
        assert int(spark.conf.get(setting)) > 4
        assert spark.read.parquet(f"{out}/context.parquet").select("filename").distinct().count() == 6
        write(tmp_path / "cases" / "7.txt", "alpha beta 7")
        command.main(arguments)
        found = spark.read.parquet(f"{out}/context.parquet")
        assert found.select("filename").distinct().count() == 7
        assert {r.category for r in found.collect()} == {"C0", "C1"}
        assert not os.path.exists(f"{out}/queries")
    finally:
        spark.conf.unset(setting)


def test_small_case_files_share_tasks(spark, tmp_path):
    """Tasks are as many as the bytes ask for, not as the files."""
    folder = tmp_path / "case"
    folder.mkdir()
    for i in range(200):
        (folder / f"{i}.txt").write_text(f"text {i}")
    setting = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "1")
    try:
        found = read_case_documents(spark, str(folder))
        assert found.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism
        assert {(r.filename, r.text) for r in found.collect()} == {(f"case/{i}.txt", f"text {i}") for i in range(200)}
    finally:
        spark.conf.set(setting, before)


def test_kept_tables_are_packed_closely_in_any_session(spark, tmp_path):
    before = spark.conf.get("spark.sql.parquet.compression.codec")
    spark.conf.set("spark.sql.parquet.compression.codec", "snappy")
    try:
        for fingerprint in (None, "rows"):
            files = materialize(spark, lambda: spark.range(5), str(tmp_path / f"t-{fingerprint}"), fingerprint=fingerprint).inputFiles()
            assert files and all(f.endswith(".zstd.parquet") for f in files)
    finally:
        spark.conf.set("spark.sql.parquet.compression.codec", before)
