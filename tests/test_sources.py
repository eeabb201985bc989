"""List, option and message files, posts and headers."""

import gzip
import zlib

import pytest
from pyspark.sql import functions as F

from sieveline.sources import config as C
from sieveline.sources import http as H
from sieveline.sources import lists as S


def write(path, text):
    path.write_text(text)
    return str(path)


def test_items(spark, tmp_path):
    write(tmp_path / "more", '#listcategory: "Other"\nhttp://sub.example/\n')
    main = write(tmp_path / "sites", '#listcategory:"Ads"\n#time: 9 0 17 30 01234\n# note\nBad.Example  # why\n\nx\nftp://files.example/\nhost.example:8080\n**\n*ip\n.Include<more>\r\n')
    df, flags = S.read_items(spark, main, "bannedsite", strip_port=True)
    got = sorted((r["item"], r["category"], r["tl"] and tuple(r["tl"])) for r in df.collect())
    tl = (9, 0, 17, 30, "01234")
    assert got == [("bad.example", "Ads", tl), ("files.example", "Ads", tl), ("host.example", "Ads", tl), ("sub.example", "Other", None)]
    assert flags == ["**", "*ip"]
    with pytest.raises(S.ListError):
        S.read_items(spark, str(tmp_path / "absent"), "x")
    assert S.read_items(spark, str(tmp_path / "absent"), "x", ignore_missing=True)[0].collect() == []
    blank = write(tmp_path / "blank", '#listcategory:" "\nitem.example\n')
    assert S.read_items(spark, blank, "x")[0].first()["category"] is None
    regex = write(tmp_path / "regex", "(?#note)Abc\n")
    assert S.read_items(spark, regex, "x", keep_case=True)[0].first()["item"] == "(?#note)Abc"


def test_item_cache(spark, tmp_path):
    df = spark.range(20).select(F.lit("l").alias("list"), F.col("id").cast("string").alias("item"))
    assert S.cached_items(spark, df, str(tmp_path / "c"), least=30) is df
    assert S.cached_items(spark, df, str(tmp_path / "c"), least=10).count() == 20 and (tmp_path / "c").exists()


@pytest.mark.parametrize(
    "line,parts,kind,weight",
    [
        ("<bad>", ("bad",), S.BANNED, 0), ("<bad><20>", ("bad",), S.WEIGHTED, 20), ("<a>,<b>", ("a", "b"), S.BANNED, 0), ("<a>,<b><-7>", ("a", "b"), S.WEIGHTED, -7),
        ("<a>, < b ><5> # note", ("a", " b "), S.WEIGHTED, 5), ("<" + "x" * 200 + ">", ("x" * 126,), S.BANNED, 0), ("<a><0>", ("a",), S.BANNED, 0),
    ],
)
def test_phrase_lines(line, parts, kind, weight):
    p = S.parse_phrase(line, exception=False)
    assert (p.parts, p.kind, p.weight) == (parts, kind, weight)


def test_phrase_lines_of_nothing():
    assert S.parse_phrase("no phrase", False) is None and S.parse_phrase("<>", False) is None
    assert S.parse_phrase("<good>", exception=True).kind == S.EXCEPTION


def test_phrase_files(spark, tmp_path):
    write(tmp_path / "inner", "<inner><3>\n#listcategory:\"Own\"\n<own><4>\n")
    path = write(tmp_path / "w", '#listcategory:"Gambling"\n<Raffle><10>\n#noconvert\n<Lotto><9>\n.Include<inner>\n<raffle><30>\n')
    base = S.read_phrase_base(spark, write(tmp_path / "e", "<fine>\n"), write(tmp_path / "b", "<raffle>,<proxy>\n<bad>\n"), path)
    single = {p.parts[0]: (p.kind, p.weight, p.category) for p in base.single()}
    assert single == {"fine": (-1, 0, None), "bad": (0, 0, None), "raffle": (1, 30, "Gambling"), "Lotto": (1, 9, "Gambling"), "inner": (1, 3, "Gambling"), "own": (1, 4, "Own")}
    assert [p.parts for p in base.combined()] == [("raffle", "proxy")]
    assert S.phrase_frame(spark, base).count() == 6 and S.combi_frame(spark, base).first()["type"] == 11
    with pytest.raises(S.ListError):
        S.read_phrases(spark, write(tmp_path / "m", ".Include<absent>\n"))
    assert S.read_phrases(spark, str(tmp_path / "m"), ignore_missing=True).phrases == []


def test_duplicate_phrases_resolve():
    p = [S.Phrase(("x",), S.WEIGHTED, 5, None, None, 0), S.Phrase(("x",), S.BANNED, 0, None, None, 1), S.Phrase(("y",), S.WEIGHTED, 5, None, None, 2), S.Phrase(("y",), S.WEIGHTED, 8, None, None, 3), S.Phrase(("x",), S.EXCEPTION, 0, None, None, 4)]
    assert [(q.parts[0], q.kind, q.weight) for q in S.PhraseBase(p).single()] == [("y", 1, 8), ("x", -1, 0)]


def test_regex_files(spark, tmp_path):
    write(tmp_path / "first", "a+\n")
    path = write(tmp_path / "r", '#listcategory:"C"\n.Include<first>\n# x\nb+\n')
    assert [(r.ord, r.pattern, r.category) for r in S.read_regexes(spark, path)] == [(0, "a+", None), (1, "b+", "C")]
    path = write(tmp_path / "p", '"a(b)"->"$1"\n"c"->""\n')
    assert [(r.pattern, r.replacement) for r in S.read_regexes(spark, path, True)] == [("a(b)", "$1"), ("c", "")]
    with pytest.raises(S.ListError):
        S.read_regexes(spark, write(tmp_path / "bad", "a->b\n"), True)


def test_addresses(spark, tmp_path):
    assert S.parse_ip("10.0.0.1")[:3] == ("ip", 167772161, 167772161)
    assert S.parse_ip("10.0.0.9/255.255.255.0")[:3] == S.parse_ip("10.0.0.77/24")[:3] == ("subnet", 167772160, 167772415)
    assert S.parse_ip("10.0.0.1-10.0.0.3")[:3] == ("range", 167772161, 167772163)
    assert S.parse_ip("Pc-1.Example") == ("host", None, None, None, "pc-1.example")
    assert S.parse_ip("10.0.0.1/99")[0] == "host"
    assert S.read_ips(spark, write(tmp_path / "i", "10.0.0.1 # a\n\nh.example\n"), "bannedip").count() == 2
    assert S.read_ip_groups(spark, write(tmp_path / "g", "10.0.0.0/24 = filter3\nnonsense\n")).first()["grp"] == 3
    assert [tuple(r) for r in S.read_user_groups(spark, write(tmp_path / "u", "# n\nAnna=filter2\n")).collect()] == [("anna", 2)]
    rooms = tmp_path / "rooms"
    rooms.mkdir()
    write(rooms / "a", "#Hall\n10.0.0.1\n10.0.0.2\n")
    write(rooms / "b", "10.0.0.9\n")
    assert {r["room"] for r in S.read_rooms(spark, str(rooms)).collect()} == {"Hall"}


def test_messages_and_labels(spark, tmp_path):
    assert [tuple(r) for r in S.read_messages(spark, write(tmp_path / "m", '"1","a ""b"" c"\nnone\n"-2",""\n')).collect()] == [(1, 'a ""b"" c'), (-2, "")]
    assert S.read_label_limits(spark, write(tmp_path / "l", "# x\nAbc = 3 # c\nAbc = 4\nd = -1\n")) == {"Abc": 3, "d": -1}


def test_time_limits(spark):
    assert S.time_limit(" 9 0 17 30 01234") == (9, 0, 17, 30, "01234") and S.time_limit("9 0 25 0 0") is None and S.time_limit("always") is None
    rows = [("2024-01-01 09:00:00", True), ("2024-01-01 17:30:59", True), ("2024-01-01 08:59:59", False), ("2024-01-07 10:00:00", False), (None, False)]
    df = spark.createDataFrame([(t, w) for t, w in rows], "t string, want boolean")
    tl = F.struct(*[F.lit(x).alias(n) for x, n in zip((9, 0, 17, 30, "01234"), ("sth", "stm", "enh", "enm", "days"))])
    assert all(r["want"] == r["got"] for r in df.select("want", S.in_time(tl, F.col("t").cast("timestamp")).alias("got")).collect())


def test_options(spark, tmp_path):
    path = write(tmp_path / "c", "loglevel = 2 # x\nloglevel = 1\nreportinglevel = '-1'\nanonymizelogs = on\nplugin = 'a'\nplugin = 'b'\n")
    options = C.read_main(spark, path)
    assert (options.loglevel, options.reportinglevel, options.anonymizelogs, options.urlcacheage) == (2, -1, 1, 900)
    assert C.every(C.parse_options(["plugin = 'a'", "plugin = b"]), "plugin") == ["a", "b"]
    for bad in ("loglevel = 9", "loglevel = many"):
        with pytest.raises(C.ConfigError):
            C.read_main(spark, write(tmp_path / "bad", bad))
    assert C.read_group(spark, write(tmp_path / "g", "groupname = 'staff'\nnaughtynesslimit = 160\n")).naughtynesslimit == 160
    assert C.parse_plugin(["plugname = 'x'", "#a=b", "junk", "k='v w'"]) == {"plugname": "x", "k": "v w"}


def test_inflate(spark):
    raw = b"text " * 50
    deflated = zlib.compressobj(wbits=-15)
    rows = [(gzip.compress(raw), "gzip", raw), (zlib.compress(raw), "deflate", raw), (deflated.compress(raw) + deflated.flush(), "deflate", raw), (raw, None, raw), (b"broken", "gzip", None), (None, "gzip", None)]
    got = spark.createDataFrame([r[:2] for r in rows], "b binary, e string").select(H.inflate("b", "e").alias("o")).collect()
    assert [r["o"] and bytes(r["o"]) for r in got] == [r[2] for r in rows]


def test_lists_of_several_files_are_read_whole(spark, tmp_path):
    folder = tmp_path / "list"
    folder.mkdir()
    write(folder / "a", "<one>\n")
    write(folder / "b", "<two>\n<three>")
    assert [p.parts[0] for p in S.read_phrases(spark, str(folder)).phrases] == ["one", "two", "three"]
    assert S.lines(spark, str(folder)) == ["<one>", "<two>", "<three>"]
    assert {r["item"] for r in S.read_items(spark, str(folder), "x")[0].collect()} == {"<one>", "<two>", "<three>"}


def test_lists_beyond_a_bound_raise(spark, tmp_path, monkeypatch):
    big = write(tmp_path / "big", "# " + "x" * (65 << 20) + "\n<lost>\n")
    with pytest.raises(S.ListError, match="bytes"):
        S.read_phrases(spark, big, ignore_missing=True)
    with pytest.raises(S.ListError, match="bytes"):
        S.read_rooms(spark, big)
    marks = write(tmp_path / "marks", "#time: 1 0 2 0 0\n" * 100_001 + "item.example\n")
    with pytest.raises(S.ListError, match="marker"):
        S.read_items(spark, marks, "x", ignore_missing=True)
    monkeypatch.setattr(S, "MARKS", 200_000)
    assert S.read_items(spark, marks, "x")[0].count() == 1


def test_unreadable_lists_are_not_missing_ones(spark, tmp_path):
    write(tmp_path / "bad", ".Include<s3-nowhere://x/y>\n")
    with pytest.raises(Exception) as e:
        S.read_phrases(spark, str(tmp_path / "bad"), ignore_missing=True)
    assert not isinstance(e.value, S.MissingList)


def test_rules_are_read_again_when_their_file_changes(spark, tmp_path):
    import os

    from sieveline.streaming.streams import Rules

    path = tmp_path / "rules"
    rules = Rules([f"file://{path}", str(tmp_path / "late")], lambda s: {"items": s.read.text(str(path))})
    write(path, "a\n")
    assert rules.now(spark)["items"].count() == 1 and rules.now(spark) and rules.loads == 1
    write(path, "a\nb\n")
    os.utime(path, (2_000_000_000, 2_000_000_000))
    assert rules.now(spark)["items"].count() == 2 and rules.loads == 2
    write(tmp_path / "late", "x\n")
    rules.now(spark)
    assert rules.loads == 3
