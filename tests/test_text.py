import os
import tempfile

from pyspark.sql import functions as F

from flipframe.functions import templates as TP
from flipframe.functions.text import pad_ids, space_word_count, strip_html, truncate_for_scoring
from flipframe.operators import pairs as PR
from flipframe.sources import files as IO


def test_truncate_for_scoring(spark):
    df = spark.createDataFrame([("x" * n,) for n in (511, 512, 513)], "t string")
    assert [r[0] for r in df.select(F.length(truncate_for_scoring("t"))).collect()] == [511, 512, 511]


def test_space_words(spark):
    df = spark.createDataFrame([("a  b",), ("",)], "t string")
    assert [r[0] for r in df.select(space_word_count("t")).collect()] == [3, 1]


def test_sentiment_template(spark):
    df = spark.createDataFrame([(0, "Bad plot here", 1, "Good plot here")],
                               "label_ex int, example string, label_counter int, counterfactual string")
    got = df.select(TP.wrap_sentiment(TP.SENTIMENT_TEMPLATES["1"])).first()[0]
    assert got == "<|BOS|>Negative review:<|SEP|>Bad plot here<|SEP|>Positive review:<|SEP|>Good plot here<|EOS|>"


def test_seed_words_short_example(spark):
    df = spark.createDataFrame([(0, "two words", 1, "x")], "label_ex int, example string, label_counter int, counterfactual string")
    got = df.select(TP.wrap_sentiment("<0>|<1>|<2>")).first()[0]
    assert got == "two|words|"


def test_pad_ids(spark):
    df = spark.createDataFrame([([5, 6, 7],), ([1, 2, 3, 4, 5, 6, 7],)], "ids array<int>")
    ids, mask, labels = pad_ids(F.col("ids"), 5, 0)
    got = [(r[0], r[1], r[2]) for r in df.select(ids, mask, labels).collect()]
    assert got[0] == ([5, 6, 7, 0, 0], [1, 1, 1, 0, 0], [5, 6, 7, 0, 0])
    assert got[1] == ([1, 2, 3, 4, 5], [1, 1, 1, 1, 1], [1, 2, 3, 4, 5])


def test_html_strip(spark):
    df = spark.createDataFrame([('<p>a &amp; b</p><script>var t="</p>";</script><!-- c -->d',)], "h string")
    assert df.select(strip_html("h")).first()[0] == "a & bd"


def test_tsv_round_trip_special_fields(spark):
    rows = [(1, 'line one\nline "two"\tx'), (2, "NA"), (3, ""), (4, "None")]
    df = spark.createDataFrame(rows, "id long, text string")
    path = os.path.join(tempfile.mkdtemp(prefix="ff-tsv-"), "t")
    IO.write_tsv(df, path)
    got = {r.id: r.text for r in IO.read_tsv(spark, path, "id long, text string").collect()}
    assert got == {1: 'line one\nline "two"\tx', 2: None, 3: None, 4: "None"}


def test_first_match_lookup(spark):
    orig = spark.createDataFrame([(0, "p0", "h", "a"), (1, "p1", "h", "b"), (2, "p2", "k", "c")],
                                 "row_order long, premise string, hypothesis string, label string")
    rev = spark.createDataFrame([(10, "cp", "h", "x"), (11, "cp", "zz", "y")],
                                "rid long, counter_prem string, original_hyp string, counter_label string")
    out = PR.revised_premise_pairs(rev, orig).collect()
    assert [(r.rid, r.original_prem, r.original_label) for r in out] == [(10, "p0", "a")]


def test_run_name_parse(spark):
    df = spark.createDataFrame([("gpt2@prompt-1@fold-0",), ("plain",)], "n string")
    p, f = IO.parse_run_name("n")
    assert [tuple(r) for r in df.select(p, f).collect()] == [("1", "0"), ("None", "0")]


def test_entities_decode_like_the_standard_library(spark):
    import html

    from flipframe.functions.text import decode_entities

    cases = ["", "no reference", "&", "&&", "& &amp", "&amp;lt;", "&lt;b&gt; &quot;x&quot; &#39;&apos;", "&copy; &middot;&hellip;&NotEqualTilde;&fjlig;", "&copy2020 &ampx &notit;",
             "&#233;&#xE9;&#XE9 &#x1F600;&#128;&#x9f;&#0;&#xD800;&#x110000;&#99999999999999999999;", "&am &quo &unknown; &nbsp;|", "a&lt", "&#;&#x;&#xZ;", "&&lt;&"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)] + [(99, None)], "i long, c string")
    got = {r.i: r.d for r in df.select("i", decode_entities("c").alias("d")).collect()}
    assert got.pop(99) is None
    assert got == {i: html.unescape(c) for i, c in enumerate(cases)}
