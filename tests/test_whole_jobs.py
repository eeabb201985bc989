"""Queries that read all of their input, on small tables made for it."""

import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry


def folder(path, **tables):
    for name, columns in tables.items():
        pq.write_table(pa.table(columns), path / f"{name}.parquet")
    return str(path)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_category_ids_of_packed_encoded_and_quoted_fields(spark, tmp_path):
    fields = ["Games", "Games, Ads|none", "Games%2CAds", '"Games, all";Ads', "N/A", "-", None]
    d = folder(tmp_path, deny_redirects={"block_id": list(range(7)), "categories": fields}, category_names={"cat_id": pa.array([1, 2, 3, 9], pa.int32()), "category": ["Games", "Ads", "Games, all", "Ads"]})
    assert rows(entry.queries()["j16_category_ids"](spark, d)) == [(0, 1, 1), (1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 2), (3, 1, 3), (3, 2, 2)]


RULES = [
    ("bannedsite", "bad.example", "Bad"), ("bannedsite", "shop.example", "ADs"), ("bannedurl", "mixed.example/bad", "Bad"), ("bannedurl", "own.example/x", None),
    ("greysite", "grey.bad.example", None), ("exceptionurl", "bad.example/fine", None),
]


def rules():
    return dict(zip(("list_name", "item", "category"), map(list, zip(*RULES))))


PAGES = [
    'see http://mixed.example/bad/page. and ftp://files.bad.example/a', '<a href="http://u:p@bad.example/"> <a href="/x/y"> http://mixed.example/good', '"http://shop.example/" <img src="x/z">',
    '"http://bad.example/1" "http://bad.example/2"', None,
]


def pages(tmp_path):
    return folder(tmp_path, documents={"doc_id": list(range(5)), "text": PAGES, "site": ["a.example", "own.example", "own.example", None, "a.example"]}, rules_item=rules())


def test_embedded_hits_of_paths_logins_ftp_and_relative_links_without_ads(spark, tmp_path):
    got = rows(entry.queries()["j14_embedded_hits"](spark, pages(tmp_path)))
    assert got == [
        (0, "ftp://files.bad.example/a", "bannedsite", "bad.example"), (0, "http://mixed.example/bad/page", "bannedurl", "mixed.example/bad"), (1, "http://own.example/x/y", "bannedurl", "own.example/x"),
        (1, "http://u:p@bad.example/", "bannedsite", "bad.example"), (2, "http://own.example/x/z", "bannedurl", "own.example/x"), (3, "http://bad.example/1", "bannedsite", "bad.example"), (3, "http://bad.example/2", "bannedsite", "bad.example"),
    ]


def test_embedded_urls_weigh_and_count_once_in_mode_2(spark, tmp_path):
    from pyspark.sql import functions as F

    from sieveline.operators.match import link_weights

    d = pages(tmp_path)
    assert rows(entry.queries()["a07_embedded_weight"](spark, d)) == [(1, 20), (2, 10), (3, 20)]
    assert {r["doc_id"]: r["score"] for r in entry.queries()["c02_verdict"](spark, d).collect()} == {0: 0, 1: 20, 2: 10, 3: 20, 4: 0}
    df = spark.read.parquet(f"{d}/documents.parquet")
    got = rows(link_weights(df, "doc_id", F.col("text"), F.lit("http://own.example"), spark.read.parquet(f"{d}/rules_item.parquet"), 10, 2))
    assert got == [(1, 20, "[bad.example own.example/x]"), (2, 10, "[own.example/x]"), (3, 10, "[bad.example]")]


def test_deep_hits_pass_over_exceptions_and_grey_sites(spark, tmp_path):
    urls = ["http://h.example/?u=http://bad.example/", "http://h.example/?u=http%3A%2F%2Fmixed.example%2Fbad", "http://h.example/?u=http://grey.bad.example/", "http://h.example/?u=http://bad.example/fine", "http://bad.example/", None]
    d = folder(tmp_path, access_log={"log_id": list(range(6)), "url": urls}, rules_item=rules())
    assert rows(entry.queries()["j15_deep_hits"](spark, d)) == [(0, 0, "bad.example/", "bannedsite", "bad.example"), (1, 0, "mixed.example/bad", "bannedurl", "mixed.example/bad")]


def test_content_filter_goes_through_all_stages(spark):
    from sieveline.operators.contentfilter import content_filter
    from sieveline.sources.config import MainOptions
    from sieveline.sources.lists import BANNED, EXCEPTION, WEIGHTED, Phrase, PhraseBase

    base = PhraseBase([Phrase(("bad",), BANNED), Phrase(("win",), WEIGHTED, 30), Phrase(("fine",), EXCEPTION)])
    big = "x" * 3000
    texts = ["", None, "virus", big + "virus", big + "bad", "bad", "win win", "fine bad swap", "swap", "swap win", "win", big]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    run = lambda o: [r[1] for r in rows(content_filter(df, "id", "t", base, 50, (("virus", "V"),), [("swap", "new")], o).select("id", "stage"))]
    some = ["banned", "banned", "exception", "rewritten", "rewritten", "checked"]
    assert run(MainOptions(maxcontentfiltersize=2)) == ["passed", "passed", "infected", "infected", "passed", *some, "passed"]
    assert run(MainOptions()) == ["passed", "passed", "infected", "infected", "banned", *some, "checked"]
    assert run(MainOptions(maxcontentfiltersize=2, maxcontentramcachescansize=2, maxcontentfilecachescansize=2))[3] == "passed"
