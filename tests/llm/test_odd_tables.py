"""Columns whose names clash with an operator's own, empty tables, long texts and repeated rows, for every operator that reads documents or pages."""

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import ann, chat, decontaminate, langid, licences, sanitise, simhash, warc, wrappers

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
MAIL = "write to someone.else@example.org at once"
#: Names that the operators use for columns of their own, names with dots and blanks, and the pipeline's names.
CLASH = ("row", "id", "key", "k", "d", "g", "fp", "f", "root", "r", "spans", "removed", "base", "terms", "found", "lines", "line", "n", "copy",
         "digest", "licence", "notices", "a.b", "with blank", "_found", "item_id", "component_id", "labels", "said", "host")


def clashing(df):
    return df.select("*", *[F.lit(f"kept {c}").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, MAIL, "aa"), (1, MAIL, "aa"), (2, LONG, "bb"), (3, None, None), (4, "", "aa"), (None, "one two three four five six seven", "bb")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def kept_whole(out, docs):
    """Every other column keeps its value."""
    assert set(clashing(docs).columns) <= set(out.columns)
    for r in out.collect():
        assert all(r[c] == f"kept {c}" for c in CLASH)


def test_language(spark, docs):
    train = [(100 + i, "kalo mipu lo ka" if i % 2 else "ster ung lich zeit", "aa" if i % 2 else "bb") for i in range(12)]
    table = docs.unionByName(spark.createDataFrame(train, docs.schema))
    out = langid.identify(clashing(table).withColumn("SCORE", F.lit(1)))
    assert out.count() == 18 and out.columns[-2:] == ["lang_pred", "score"] and "SCORE" not in out.columns
    kept_whole(out, table)


def test_sanitise(docs):
    out = sanitise.sanitise(clashing(docs))
    kept_whole(out, docs)
    assert sorted(len(r.text or "") for r in out.collect())[-1] == len(LONG)
    assert out.where("text LIKE '%@%'").count() == 0 and out.where("text IS NULL").count() == 1
    assert sanitise.sanitise(clashing(docs).limit(0)).columns == clashing(docs).columns


def test_simhash(docs):
    out = simhash.keep_one(clashing(docs))
    kept_whole(out, docs)
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "3", "None"]  # 3 and 4 have no words
    assert simhash.keep_one(clashing(docs).limit(0)).count() == 0


def test_decontaminate(spark, docs):
    items = spark.createDataFrame([(7, "one two three four five six seven"), (8, None), (9, "")], "item_id long, text string")
    out = decontaminate.keep_clean(clashing(docs), items.withColumn("key", F.lit("x")), chance=1e9)
    kept_whole(out, docs)
    assert out.count() == 5 and out.where("doc_id IS NULL").count() == 0
    assert decontaminate.keep_clean(clashing(docs), items.limit(0)).count() == 6
    assert decontaminate.keep_clean(clashing(docs).limit(0), items).count() == 0


def test_licences(docs):
    plain = sorted(map(tuple, licences.scan(docs).collect()), key=str)
    assert sorted(map(tuple, licences.scan(clashing(docs)).collect()), key=str) == plain and len(plain) == 6
    assert licences.scan(clashing(docs).limit(0)).count() == 0


def test_pages(spark):
    rows = [(1, "http://h.example/1", "<p>" + LONG + "</p>"), (1, "http://h.example/1", "<p>" + LONG + "</p>"), (2, None, None), (None, "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert warc.round_trip(clashing(pages)).count() == 4 and warc.round_trip(clashing(pages).limit(0)).count() == 0
    texts = sorted(r.text for r in wrappers.extract(clashing(pages)).collect())
    assert texts == ["", "", LONG, LONG]
    assert wrappers.extract(clashing(pages).limit(0)).count() == 0


def test_vectors_and_turns(spark):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)] + [(4, [4.0, 1.0]), (5, None)], "vec_id long, embedding array<double>")
    out = ann.Index(clashing(vectors), k=2).search(clashing(vectors))
    assert out.where("query_id = 0").count() == 2 and out.where("query_id = 5").count() == 0
    turns = spark.createDataFrame([(1, 0, "user", LONG), (1, 0, "user", LONG), (None, None, None, None)], "conv_id long, turn int, role string, text string")
    back = chat.read_back(chat.render(chat.fold(chat.turn_events(clashing(turns))))).collect()
    assert sorted(len(r.turns) for r in back) == [1, 2] and all(t.text in (LONG, "") for r in back for t in r.turns)
    assert chat.render(chat.fold(chat.turn_events(clashing(turns).limit(0)))).count() == 0
