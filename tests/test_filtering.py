"""Text and url functions, phrases, verdicts, state, sinks and scanners."""

import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.functions import text as X
from sieveline.functions import url as U
from sieveline.operators import identity as ID
from sieveline.operators import match as M
from sieveline.operators import phrases as P
from sieveline.operators import scanners as SC
from sieveline.operators import verdict as V
from sieveline.plans.inline import phrase_base
from sieveline.sinks import log as K
from sieveline.sources.lists import BANNED, EXCEPTION, WEIGHTED, Phrase, PhraseBase, Regex
from sieveline.streaming import state as ST
from sieveline.streaming.streams import Rules


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in sorted(df.select("i", f(F.col("v"))).collect())]


def test_text_functions(spark):
    assert column(spark, ["ÀÉ×ß\tA\n", None, ""], X.fold) == ["àé×ß a ", None, ""]
    assert column(spark, ["a<b>c", "x <i", "a > b", "<<a>>", None, "", "plain"], X.smart_strip) == [" a c", " x ", " a b", " ", None, " ", " plain"]
    assert column(spark, ['<meta name="a" content="b, c"><title>t(x)</title></head><title>no', "<p>", None], X.meta_title) == ["name a content b c t x", "", None]
    assert column(spark, ["a:b:c", "none", None], lambda c: X.after(c, ":")) == ["b:c", "", None]
    assert column(spark, ["a:b:c", "none", None], lambda c: X.before(c, ":")) == ["a", "", None]
    assert column(spark, ["\t a \r\n", " \t", None], X.remove_white_space) == ["a", " \t", None]
    assert column(spark, ["a..b...c", "$$"], lambda c: X.collapse(X.collapse(c, "."), "$")) == ["a.b.c", "$"]
    assert column(spark, [" 12x", "-3", "x", "99999999999", None], X.to_int) == [12, -3, 0, 0, None]
    assert column(spark, ["ff", "90", "g", None], X.hex_to_int) == [255, 144, None, None]
    assert column(spark, ["a%20b", "100%", "%zz+%41", "é%C3%A9", None], X.percent_decode) == ["a b", "100%", "%zz+A", "éé", None]
    assert column(spark, ["%41%2d%2F%zz", "none"], X.safe_decode) == ["A-%2F%zz", "none"]
    assert column(spark, ["aZ9", "a b", "é/", "", None], X.mini_url_encode) == ["aZ9", "a%20b", "%c3%a9%2f", "", None]
    assert column(spark, ["x" * 40, "x" * 41], X.display_url) == ["x" * 40, "x" * 40 + "..."]
    assert column(spark, ["abc", "", "a"], X.chop) == ["ab", "", ""] and column(spark, ["abc", ""], X.lop) == ["bc", ""]


def test_overlapping_counts(spark):
    assert column(spark, [" the the the ", "thethe", None, ""], lambda c: X.overlapping_count(c, " the ")) == [3, 0, None, 0]
    assert column(spark, ["aaaa"], lambda c: X.overlapping_count(c, "aa")) == [3]
    assert column(spark, ["a.b\\Ec"], lambda c: X.overlapping_count(c, "\\E")) == [1]


def test_rewrites(spark):
    assert column(spark, ["Aab\nB", "x"], lambda c: X.rewrite(c, [("(a)(b)", r"$2\1"), ("a.b", "")])) == ["Ab", "x"]
    assert column(spark, ["ab"], lambda c: X.rewrite(c, [("(a)", r"$10\$\\")])) == ["a0$\\b"]
    assert column(spark, ["a1"], lambda c: X.rewrite(c, [("[[:digit:]]", "#")])) == ["a#"]


def brute_suffixes(host):
    labels = host.split(".")
    return [".".join(labels[i:]) if i < len(labels) - 1 or len(labels) == 1 else "." + labels[-1] for i in range(len(labels))]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.from_regex(r"[a-c]{1,2}(\.[a-c]{1,2}){0,3}", fullmatch=True), min_size=1, max_size=20))
def test_host_suffixes(spark, hosts):
    assert column(spark, hosts, U.host_suffixes) == [brute_suffixes(h) for h in hosts]


def test_site_and_url_hits(spark):
    urls = ["http://a.b.example/x/y?q=1", "http://b.example/", "http://other.tld/p=2&r", "http://b.example/xyz", None, "http://user@A.B.Example:80/x/"]
    df = spark.createDataFrame(list(enumerate(urls)), "id int, url string")
    sites = spark.createDataFrame([("b.example", "C"), ("B.example", "B"), ("a.b.example", None), (".tld", "T")], "item string, category string")
    key = U.list_key(F.col("url"))
    got = {r["id"]: (r["item"], r["category"]) for r in M.site_hits(df, ["id"], F.regexp_extract(key, "^[^/?]*", 0), sites).collect()}
    assert got == {0: ("a.b.example", None), 1: ("b.example", "B"), 2: (".tld", "T"), 3: ("b.example", "B"), 5: ("a.b.example", None)}
    items = spark.createDataFrame([("b.example/x", "P"), ("a.b.example/x/y", "Q"), ("other.tld/p", "R"), ("b.example", "bare")], "item string, category string")
    got = {r["id"]: r["item"] for r in M.url_hits(df, ["id"], key, items).collect()}
    assert got == {0: "a.b.example/x/y", 2: "other.tld/p", 5: "b.example/x"}
    assert M.site_hits(df.limit(0), ["id"], F.col("url"), sites).collect() == []


def test_ip_hits(spark):
    rng = random.Random(1)
    rules = [(rng.randrange(2**32), rng.choice([0, 1, 300, 70_000, 2**25]), i) for i in range(40)] + [(0, 2**32 - 1, 99), (50, -10, 98)]
    rules = [(lo, min(lo + n, 2**32 - 1), i) for lo, n, i in rules]
    ips = [rng.randrange(2**32) for _ in range(50)] + [r[0] for r in rules] + [r[1] for r in rules[:40]] + [None]
    df = spark.createDataFrame(list(enumerate(ips)), "id int, n long")
    got = {tuple(r) for r in M.ip_hits(df, ["id"], F.col("n"), spark.createDataFrame(rules, "lo long, hi long, rule int"), ["rule"]).collect()}
    assert got == {(k, i) for k, n in enumerate(ips) if n is not None for lo, hi, i in rules if lo <= n <= hi}


def naive_hits(texts, needles):
    return {(i, p, n) for i, t in enumerate(texts) if t for p in needles if (n := sum(t.startswith(p, k) for k in range(len(t))))}


@pytest.mark.parametrize("few", [0, 1000])
def test_phrase_hits(spark, few):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab é") for _ in range(rng.randrange(60))) for _ in range(40)] + [None, "", "a" * 5000]
    needles = ["a", "aa", "ab a", " b ", "é", "aba"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    assert {tuple(r) for r in P.phrase_hits(df, ["id"], "t", needles, few).collect()} == naive_hits(texts, needles)
    assert P.phrase_hits(df, ["id"], "t", [""], few).collect() == []


def judge(spark, texts, phrases, limit=50, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    return {r["id"]: (r["outcome"], r["score"], r["reason"], r["categories"]) for r in P.score_texts(df, "id", "t", PhraseBase(phrases), limit, **options).collect()}


def test_verdict_precedence(spark):
    p = [
        Phrase(("win",), WEIGHTED, 30, "Games"), Phrase(("learn",), WEIGHTED, -20, "Good"), Phrase(("bad",), BANNED), Phrase(("fine",), EXCEPTION), Phrase(("a1", "a2"), EXCEPTION), Phrase(("b1", "b2"), BANNED), Phrase(("w1", "w2"), WEIGHTED, 60, "Combi"),
    ]
    got = judge(spark, ["win win", "win learn", "win bad", "bad fine", "bad fine a1 a2", "b1 b2 bad", "w1 w1 w2", "w1", None, "", "WIN <b>win</b>"], p)
    assert got[0] == ("weighted", 60, "50 : 60 (win)", "Games") and got[1] == ("clean", 10, "", "Games")
    assert [got[k][0] for k in range(2, 6)] == ["banned", "exception", "combination exception", "banned combination"]
    assert got[6] == ("weighted", 60, "50 : 60 ((w1, w2))", "Combi") and got[7][:2] == got[8][:2] == got[9][:2] == ("clean", 0)
    assert got[10][0] == "weighted"
    assert judge(spark, ["win win"], p, mode=2)[0][:2] == ("clean", 30)
    assert judge(spark, ["WIN win"], p, filter_mode=0, preserve_case=1)[0][:2] == ("clean", 30)
    # equal to the limit is not above it; each pass stands alone
    assert judge(spark, ["win learn win win"], p, limit=70)[0][0] == "clean"


def test_combination_min_count_and_shared_parts(spark):
    p = [Phrase(("x",), WEIGHTED, 9), Phrase(("x",), WEIGHTED, 5), Phrase(("x", "y"), WEIGHTED, 7), Phrase(("y", "z"), WEIGHTED, 100)]
    assert judge(spark, ["x x y y y"], p, limit=1000, filter_mode=0)[0][1] == 2 * 9 + 2 * 7


def test_category_texts(spark):
    df = spark.createDataFrame([(1, "b", 5), (1, "a", 5), (1, "c", 9), (2, "z", 1)], "id int, category string, score long")
    text = lambda t: {r["id"]: r["categories"] for r in P.category_text(df, ["id"], t).collect()}
    assert text(0) == {1: "c, a, b", 2: "z"} and text(5) == {1: "c, a, b"} and text(-1) == {1: "c", 2: "z"}


def test_empty_tables(spark):
    df = spark.createDataFrame([], "id int, t string")
    assert P.score_texts(df, "id", "t", phrase_base(), 10).collect() == []


def test_request_verdicts(spark):
    items = spark.createDataFrame(
        [("bannedsite", "bad.example", "B"), ("greysite", "grey.bad.example", None), ("exceptionsite", "ok.bad.example", "X"), ("bannedurl", "half.example/x", "U"), ("greyurl", "half.example/x/y", None), ("exceptionurl", "half.example/x/z", None)],
        "list_name string, item string, category string",
    )
    ips = spark.createDataFrame([("bannedip", "ip", 167772161, 167772161, None, None), ("rooms", "ip", 167772161, 167772161, None, "hall"), ("exceptionip", "ip", 167772162, 167772162, None, None), ("bannedip", "host", None, None, "PC.example", None)], "list_name string, kind string, lo long, hi long, host string, room string")
    rows = [
        (1, "http://bad.example/", "10.0.0.9", None), (2, "http://a.grey.bad.example/", "10.0.0.9", None), (3, "http://ok.bad.example/", "10.0.0.1", None), (4, "http://half.example/x?q", "10.0.0.9", None), (5, "http://half.example/x/y/1", "10.0.0.9", None),
        (6, "http://half.example/x/z", "10.0.0.9", None), (7, "http://fine.example/", "10.0.0.1", None), (8, "http://bad.example/", "10.0.0.2", None), (9, "http://fine.example/", None, "pc.Example"), (10, "http://grey.bad.example/evil", "10.0.0.9", None), (11, None, None, None), (12, "http://ok.bad.example/", "10.0.0.9", None),
    ]
    df = spark.createDataFrame(rows, "id int, url string, ip string, client_host string")
    got = {r["id"]: (r["code"], r["item"], r["category"]) for r in V.request_verdicts(df, "id", items, ips, [Regex(0, "evil", None, "R")]).collect()}
    assert got[1] == (500, "bad.example", "B") and got[2][0] == 0 and got[12] == (602, "ok.bad.example", "X") and got[4] == (501, "half.example/x", "U")
    # being a banned client overrides that a site is in the exception lists
    assert got[3] == (100, None, "Banned Room")
    assert got[5][0] == 0 and got[6][0] == 603 and got[7] == (100, None, "Banned Room") and got[8][0] == 600 and got[9] == (100, None, "Banned Client IP") and got[10][0] == 0 and got[11][0] == 0
    over = {r["id"]: r["code"] for r in V.request_verdicts(df, "id", items, ips, [Regex(0, "evil", None, "R")], regex_over_grey=True).collect()}
    assert over[10] == 503
    modes = {r["id"]: r["code"] for r in V.request_verdicts(df, "id", items, ips, group_mode=F.when(F.col("id") == 1, 2).otherwise(0)).collect()}
    assert modes[1] == 601 and modes[2] == 102 and modes[3] == 100


def test_time_limits_in_verdicts(spark):
    tl = "named_struct('sth', 9, 'stm', 0, 'enh', 17, 'enm', 0, 'days', '01234')"
    items = spark.sql(f"SELECT 'bannedsite' AS list_name, 'bad.example' AS item, 'day' AS category, {tl} AS tl UNION ALL SELECT 'exceptionsite', 'bad.example', 'weekend', named_struct('sth', 0, 'stm', 0, 'enh', 23, 'enm', 59, 'days', '56')")
    ips = spark.createDataFrame([], "list_name string, kind string, lo long, hi long, host string, room string")
    times = {1: "2024-01-01 10:00:00", 2: "2024-01-01 18:00:00", 3: "2024-01-06 10:00:00", 4: None}
    df = spark.createDataFrame([(i, "http://bad.example/", None, None, t) for i, t in times.items()], "id int, url string, ip string, client_host string, t string").withColumn("ts", F.col("t").cast("timestamp"))
    got = {r["id"]: (r["code"], r["category"]) for r in V.request_verdicts(df, "id", items, ips, ts="ts").collect()}
    assert got == {1: (500, "day"), 2: (0, None), 3: (602, "weekend"), 4: (0, None)}
    assert {r["code"] for r in V.request_verdicts(df, "id", items, ips).collect()} == {602}


def test_download_verdicts(spark):
    items = spark.createDataFrame([("bannedextension", ".zip", None), ("bannedmimetype", "application/zip", None), ("exceptionextension", ".ok.zip", None), ("exceptionfilesite", "good.example", None), ("exceptionmimetype", "text/safe", None)], "list_name string, item string, category string")
    rows = [
        (1, "http://h.example/a.ZIP", "text/html", None, 200), (2, "http://h.example/a.ok.zip", "application/zip", None, 200), (3, "http://good.example/a.zip", "x/y", None, 200), (4, "http://h.example/a.zip?x", "text/html", None, 200),
        (5, "http://h.example/a.zip?x", "application/x", None, 200), (6, "http://h.example/a", "Application/Zip", None, 200), (7, "http://h.example/a", "t/x", "b.zip", 200), (8, "http://h.example/a.zip", "t/x", None, 302), (9, "http://h.example/a.zip", "text/safe", None, 200), (10, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "id int, url string, mimetype string, disposition string, code int")
    got = {r["id"]: r["code"] for r in V.download_verdicts(df, "id", items).collect()}
    assert got == {1: 900, 2: 0, 3: 0, 4: 0, 5: 900, 6: 800, 7: 900, 8: 0, 9: 0, 10: 0}
    assert {r["id"]: r["code"] for r in V.download_verdicts(df, "id", items, block_all=True).collect()}[4] == 750


def test_violations(spark):
    rows = [("u", t, i) for i, t in enumerate([0, 5, 9, 100, 300, 900, 901])] + [(None, 1, 90), ("v", 1, 91)]
    df = spark.createDataFrame(rows, "u string, t long, i int")
    got = {(r["u"], r["first"], r["last"]) for r in ST.violation_alerts(df, "u", "t", 3, 50).collect()}
    assert got == {("u", 0, 9)}
    assert ST.violation_alerts(df, "u", "t", 3).count() == 2


def test_active_clients(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abcdef"), rng.randrange(0, 20_000)) for _ in range(60)]
    got = {r["tick_s"]: (r["current"], r["peak"]) for r in ST.active_clients(spark.createDataFrame(rows, "ip string, s long"), "ip", "s", 500, 180).collect()}
    up = lambda t: -(-t // 180) * 180
    spans = []
    for k in "abcdef":
        ts = sorted(t for a, t in rows if a == k)
        for t in ts:
            if spans and spans[-1][0] == k and t - spans[-1][2] <= 500:
                spans[-1][2] = t
            else:
                spans.append([k, t, t])
    for tick, (current, _) in got.items():
        assert current == sum(up(a) <= tick < up(b + 501) for _, a, b in spans)
    assert max(c for c, _ in got.values()) == max(p for _, p in got.values()) <= 6
    assert got[max(got)][0] == 0


def test_groups_and_tokens(spark):
    rules = spark.createDataFrame([("ip", 5, 5, 3), ("subnet", 0, 255, 1), ("range", 4, 300, 2), ("range", 290, 310, 1)], "kind string, lo long, hi long, grp int")
    df = spark.createDataFrame([(1, 5), (2, 6), (3, 295), (4, 999), (5, None)], "id int, n long")
    assert {r["id"]: r["grp"] for r in ID.ip_groups(df, ["id"], F.col("n"), rules).collect()} == {1: 3, 2: 1, 3: 1}
    url = F.lit("http://h/?a=1")
    link = ID.bypass_token(url, "m", F.lit("1.2.3.4"), F.lit(100))
    r = spark.range(1).select(ID.bypass_holds(link, "m", F.lit("1.2.3.4"), F.lit(100)), ID.bypass_holds(link, "m", F.lit("1.2.3.4"), F.lit(101)), ID.bypass_holds(link, "m", F.lit("9.9.9.9"), F.lit(1)), ID.bypass_holds(url, "m", F.lit("1.2.3.4"), F.lit(1))).first()
    assert tuple(r) == (True, False, False, False)


def test_log_lines(spark):
    with pytest.raises(ValueError):
        K.log_lines(spark.range(1), 9)
    got = column(spark, ["http://h/x", "http://h:8080/", "http://u:p@h", None, "x"], lambda c: K.with_port(c, F.lit(3128)))
    assert got == ["http://h:3128/x", "http://h:8080/", "http://u:p@h:3128", None, "x"]
    assert column(spark, [5, 1234567], K.squid_duration, "long") == ["     5", "1234567"]
    for level, want in ((0, [False, False]), (1, [True, False]), (3, [True, True])):
        assert column(spark, [True, None], lambda c, n=level: K.admitted(n, c, F.lit(False), F.lit("x"), F.lit("image/x")), "boolean") == want
    page = spark.range(1).select(K.block_page("-URL- -SHORTURL-", URL=F.lit("<a&b>"))).first()[0]
    assert page == "&lt;a&amp;b&gt; &lt;a&amp;b&gt;"
    link = spark.range(1).select(K.redirect_url("http://d/", F.lit("u v"), F.lit("1"), F.lit(""), F.lit("c"), F.lit("r"))).first()[0]
    assert link == "http://d/?DENIEDURL=u%20v&IP=1&USER=&CATEGORIES=c&REASON=r"
    for level, action in ((-1, "pass"), (0, "text"), (1, "redirect"), (3, "image")):
        assert spark.range(1).select(K.denial(level, F.lit("image/png"), F.lit("p"), F.lit("r"))["action"]).first()[0] == action


def test_sinks_write(spark, tmp_path):
    from sieveline.plans.logs import _COLUMNS

    df = spark.read.parquet("/root/testdata/sf0.001/access_log.parquet").select("log_id", *_COLUMNS)
    for fmt in (1, 2, 3, 4):
        K.write_log(df, str(tmp_path / f"log{fmt}"), fmt)
        assert spark.read.text(str(tmp_path / f"log{fmt}")).count() == df.count()
    K.store_blocked(df.filter("is_naughty"), str(tmp_path / "blocked"), "naughty_type")
    assert spark.read.parquet(str(tmp_path / "blocked")).count() == df.filter("is_naughty").count()


def test_scanners(spark):
    assert SC.scanner("signature") is SC.signature_scan
    with pytest.raises(KeyError):
        SC.scanner("none")
    with pytest.raises(ValueError):
        SC.register("signature")(SC.signature_scan)
    assert column(spark, ["x TESTVIRUS", "x", None], lambda c: SC.signature_scan(c)["code"]) == [1, 0, 0]
    assert column(spark, [True, None], lambda c: SC.wants_scan(c, F.lit(False), F.lit(None).cast("boolean"), F.lit(False)), "boolean") == [False, True]


def test_rules_reload(spark, tmp_path):
    import os

    path = tmp_path / "rules"
    path.write_text("a")
    rules = Rules([str(path)], lambda s: {"r": s.range(1)})
    rules.now(spark), rules.now(spark)
    assert rules.loads == 1
    os.utime(path, ns=(1, 1))
    rules.now(spark)
    assert rules.loads == 2
