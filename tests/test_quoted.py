import csv
import io
import os
import random
import tempfile

import pytest

from flipframe.sources import files as IO
from flipframe.sources import quoted as Q

TEXTS = ["plain", "", "tab\there", "two\nlines", 'a "quoted" word', '"', '""', "\n", "\n\n", 'ends "', 'end\n"x"\tand\nmore', "back\\slash", "é漢\U0001f600\n'", "cr\r\nlf", " lead", "a\n" * 40]


@pytest.fixture
def small_splits(spark):
    keys = {"spark.sql.files.maxPartitionBytes": "4000", "spark.sql.files.openCostInBytes": "10"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def write(rows, quoting=csv.QUOTE_MINIMAL, end="\n", header=("id", "text", "tail")):
    folder = tempfile.mkdtemp(prefix="ff-quoted-")
    for part, chunk in enumerate((rows[: len(rows) // 3], rows[len(rows) // 3 :])):
        out = io.StringIO()
        w = csv.writer(out, delimiter="\t", quoting=quoting, lineterminator=end)
        w.writerows([header, *chunk])
        with open(os.path.join(folder, f"part-{part}.tsv"), "w", newline="") as f:
            f.write(out.getvalue())
    return folder


def test_one_file_in_many_splits_equals_a_plain_reader(spark, small_splits):
    r = random.Random(1)
    rows = [(i, "".join(r.choices(TEXTS, k=r.randint(1, 6))), r.choice(TEXTS)) for i in range(3000)]
    for quoting, end in ((csv.QUOTE_MINIMAL, "\n"), (csv.QUOTE_ALL, "\r\n")):
        folder = write(rows, quoting, end)
        assert spark.read.text(folder).rdd.getNumPartitions() > 20
        got = Q.read_quoted(spark, folder, "id long, text string, tail string", options=IO.FIELD_OPTIONS).collect()
        blank = "" if quoting == csv.QUOTE_ALL else None  # an empty field that is not quoted is null
        assert sorted((x.id, x.text, x.tail) for x in got) == sorted((i, t, u) if u else (i, t, blank) for i, t, u in [(i, t or blank, u) for i, t, u in rows])


def test_record_longer_than_many_splits(spark, small_splits):
    rows = [(0, "x\n" * 20_000, "a"), (1, "y" * 50_000, "b"), (2, "z", "c\n" * 9000), (3, "w", "d")]
    got = Q.read_quoted(spark, write(rows), "id long, text string, tail string").collect()
    assert sorted(map(tuple, got)) == rows


def test_a_cut_at_every_byte_gives_the_same_records(spark):
    text = 'id\ttext\n1\t"a\n""b""\tc\n"\n2\tplain " quote\n\n3\t"x"y\n4\t""\n5\t\n6\t"\n'
    folder = tempfile.mkdtemp(prefix="ff-cut-")
    with open(os.path.join(folder, "f.tsv"), "w") as f:
        f.write(text)
    want = None
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (1000, 1, 3, 7, 13):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            got = sorted(map(tuple, Q.read_quoted(spark, folder, "id string, text string", options=IO.FIELD_OPTIONS).collect()), key=repr)
            want = want or got
            assert got == want, size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert want[0] == ("1", 'a\n"b"\tc\n') and ("2", 'plain " quote') in want and ("4", "") in want and ("5", None) in want


def test_line_effects():
    cases = [("a\tb", False, False), ('"a', False, True), ('a"b\tc', False, False), ('x\t"y\tz', False, True), ('y"\tz', True, False),
             ('y""', True, True), ('y"""', True, False), ('y"\t"z', True, True), ('"a"b"c\t"', False, True), ("", True, True), ("", False, False)]
    for line, start, end in cases:
        assert Q.ends_inside(line, start, "\t") is end, line


def test_lines_and_csv_columns(spark):
    df = spark.createDataFrame([(1, "a\nb"), (2, 'say "x", y'), (3, "p,q")], "id long, text string")
    folder = tempfile.mkdtemp(prefix="ff-lines-")
    IO.write_lines(df, "text", folder + "/l")
    assert sorted(r.text for r in IO.read_lines(spark, folder + "/l").collect()) == sorted(["a\nb", 'say "x", y', "p,q"])
    df.write.option("header", "true").option("escape", '"').csv(folder + "/c")
    for schema in (None, "id long, text string"):
        assert sorted(r.text for r in IO.read_csv_column(spark, folder + "/c", "text", schema).collect()) == sorted(["a\nb", 'say "x", y', "p,q"])


def test_text_is_not_shuffled(spark):
    folder = write([(1, "a", "b")])
    plan = Q.read_quoted(spark, folder, "id long, text string, tail string")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
