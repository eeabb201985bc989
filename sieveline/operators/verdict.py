"""Verdicts on requests and downloads: every list is looked up, then the precedence picks one reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions import logfields as L
from sieveline.functions import text as X
from sieveline.functions import url as U
from sieveline.operators.match import address_keys, blanket, deep_urls, extension_keys, first_header_regex, first_regex, range_keys, url_keys
from sieveline.operators.phrases import OUTCOMES, contributions, phrase_hits
from sieveline.operators.phrases import verdicts as phrase_verdicts
from sieveline.sources.lists import LIMIT, PhraseBase, Regex, in_time

#: Reason codes, as the message catalogue numbers them. Fixed values.
CODES = {
    "banned client": 100, "banned user": 102, "search terms": 400, "banned site": 500, "banned url": 501, "banned expression": 503, "banned header": 508,
    "exception client": 600, "exception user": 601, "exception site": 602, "exception url": 603, "exception expression": 609,
    "blanket download": 750, "banned type": 800, "banned extension": 900,
}


def hits_by_list(keyed: DataFrame, ids: list[str], rules: DataFrame) -> DataFrame:
    """(ids, list_name, item, category): the first of the __keys of each fact that is an item, for each list at once."""
    named = rules.groupBy("list_name", F.lower(F.trim("item")).alias("item")).agg(F.min("category").alias("category"))
    keyed = keyed.select(*ids, F.posexplode_outer("__keys").alias("pos", "item"))
    best = F.min(F.struct("pos", "item", "category")).alias("b")
    return keyed.join(named, "item").groupBy(*ids, "list_name").agg(best).select(*ids, "list_name", "b.item", "b.category")


@dataclass(frozen=True)
class Search:
    """How terms of searches are judged: the patterns that find them in urls, their own phrases and limit."""

    patterns: tuple[str, ...]
    base: PhraseBase
    limit: int


def search_verdicts(requests: DataFrame, id_col: str, search: Search) -> DataFrame:
    """(id, outcome, score, reason, categories) of requests (id, url) whose search terms have phrases of the list.

    Terms are padded with blanks and searched as they stand, folded. All columns of the requests go through the
    search, so that a caller who reads them anyway has them read once.
    """
    terms = X.fold(F.concat(F.lit(" "), U.search_terms(F.col("url"), list(search.patterns)), F.lit(" ")))
    rows = requests.withColumn("__terms", terms).filter("__terms IS NOT NULL")
    hits = phrase_hits(rows, requests.columns, "__terms", search.base.needles(), few=0).select(id_col, "phrase", "n")
    return phrase_verdicts(contributions(hits, [id_col], search.base), [id_col], search.limit)


def request_verdicts(requests: DataFrame, id_col: str, items: DataFrame, ips: DataFrame, banned_regexes: list[Regex] = (), exception_regexes: list[Regex] = (), regex_over_grey: bool = False, group_mode: Column | None = None, ts: str | None = None, is_ssl: Column | None = None, headers: Column | None = None, header_regexes: list[Regex] = (), flags: dict[str, list[str]] | None = None, search: Search | None = None, deep: bool = False, own: Column | None = None) -> DataFrame:
    """(id, verdict, code, item, category, room) of every request.

    requests: (id, url, ip, client_host). items: (list_name, item, category) with bannedsite, bannedurl,
    greysite, greyurl, exceptionsite, exceptionurl; ips: address rules of bannedip, exceptionip and rooms.

    Banned addresses, rooms and users (group mode 0) come first: no exception helps them. Then what is the own deny
    server's, the exceptions (group mode 2, address, site, url, expression), search terms (not of SSL requests),
    and, unless the site or url is grey, banned site, url, expression and header, and last urls within the url.
    With regex_over_grey expressions come before the grey lists and hold in spite of them. flags: those of a list
    by its name, which ban, free or grey everything of a kind. deep: the last url within the url that is banned
    by site or url counts, those on an exception or grey list are passed over. verdict is "exception", "own",
    "banned" or "clean". Requests must have an id of their own; each comes out once. ts: a column of the
    requests; rules with a time limit `tl` then hold only within it, else they always hold.

    The requests are read once: each makes the keys by which sites, urls, addresses and hosts are looked up and
    a key that meets nothing, all in one join with all rules; what is left of it, a row for each hit and one
    for each request, is partially aggregated and shuffled once. Hits of search terms are shuffled beside it.
    """
    names = ["bannedsite", "bannedurl", "greysite", "greyurl", "exceptionsite", "exceptionurl", "bannedip", "exceptionip", "rooms"]
    none, false, flags = F.lit(None).cast("string"), F.lit(False), flags or {}
    tagged = lambda tag, c: F.transform(c, lambda x: F.concat(F.lit(tag), x))
    or_false = lambda c: F.coalesce(c, false)
    looked = requests.select(
        id_col, F.lower("client_host").alias("__client"), U.ip_number(L.ip_key(F.col("ip"))).alias("__n"), F.col("url").alias("__url"),
        (F.lit(1) if group_mode is None else group_mode).alias("__mode"), (F.col(ts) if ts else F.lit(None)).cast("timestamp_ntz").alias("__ts"),
        or_false(F.lower("url").startswith("https") if is_ssl is None else is_ssl).alias("__ssl"), or_false(false if own is None else own).alias("__own"),
        (first_header_regex(headers, list(header_regexes)) if headers is not None else F.lit(None).cast("int")).alias("__hr"), F.lit(-1).alias("__deep"),
    )
    sent = [id_col, "__client", "__n", "__mode", "__ts", "__ssl", "__own", "__hr"]
    if deep:
        # urls within become rows before their keys are made, so keys are made in generated code, once a row;
        # outer: else the optimizer would test the array before the explode, working its texts out once more
        within = F.transform(deep_urls(F.col("__url")), lambda u: F.concat(F.lit("http://"), u))
        every = F.concat(F.array("__url"), F.coalesce(within, F.array().cast("array<string>")))
        looked = looked.select(*sent, F.posexplode_outer(every).alias("__deep", "__url")).withColumn("__deep", F.col("__deep") - 1)
    looked = looked.withColumns({"__site": L.site_key(F.col("__url")), "__look": U.list_key(F.col("__url"))})
    looked = looked.withColumns({"__br": first_regex(F.col("__look"), list(banned_regexes)), "__er": first_regex(F.col("__look"), list(exception_regexes)), "__ip": or_false(U.is_ip_host(F.col("__site")))})
    carried = ["__mode", "__br", "__er", "__hr", "__ssl", "__own", "__ip"]
    kept = [id_col, "__n", *carried, "__ts"]
    sited = looked.select(*kept, "__deep", "__client", "__look", U.host_suffixes(F.col("__site")).alias("__sites"))
    keyed = url_keys(sited, [*kept, "__deep", "__client", "__sites"], F.col("__look"))
    whole = F.col("__deep") < 0
    keys = [tagged("s:", F.col("__sites")), tagged("u:", F.col("__keys"))]
    once = [tagged("n:", address_keys(F.col("__n"))), F.array(F.concat(F.lit("h:"), "__client")), F.array(F.concat(F.lit("-:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))]
    empty = F.array().cast("array<string>")
    every = F.concat(*[F.coalesce(k, empty) for k in keys], *[F.when(whole, F.coalesce(k, empty)).otherwise(empty) for k in once])
    facts = keyed.select(*kept, "__deep", F.posexplode_outer(every).alias("__pos", "__k"))
    limit = F.lit(None) if ts is None or "tl" not in items.columns else F.col("tl")
    listed = items.filter(F.col("list_name").isin(*names)).groupBy("list_name", F.lower(F.trim("item")).alias("item"), limit.cast(LIMIT).alias("tl")).agg(F.min("category").alias("category"))
    kind = F.when(F.col("list_name").endswith("site"), "s:").otherwise("u:")
    no_range, no_limit = [F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi")], F.lit(None).cast(LIMIT).alias("tl")
    addresses = ips.filter("list_name IN ('bannedip', 'exceptionip', 'rooms')")
    ranges = range_keys(addresses.filter("kind <> 'host'"), ["list_name", "room", "lo", "hi"])
    rules = (
        listed.select("list_name", "item", "category", F.concat(kind, "item").alias("__k"), *no_range, "tl")
        .unionByName(ranges.select("list_name", none.alias("item"), F.col("room").alias("category"), F.concat(F.lit("n:"), "key").alias("__k"), "lo", "hi", no_limit))
        .unionByName(addresses.filter("kind = 'host'").select("list_name", none.alias("item"), F.col("room").alias("category"), F.concat(F.lit("h:"), F.lower("host")).alias("__k"), *no_range, no_limit))
    )
    met = facts.join(rules, "__k", "left").filter(F.col("__k").startswith("-:") | (F.col("list_name").isNotNull() & (F.col("lo").isNull() | F.col("__n").between(F.col("lo"), F.col("hi"))) & in_time(F.col("tl"), F.col("__ts"))))
    one = lambda name: F.min(F.when((F.col("list_name") == name) & whole, F.struct("__pos", "item", "category"))).alias(name)
    # a url holds few others, so what is collected of a request is bounded by its length
    inner = [F.collect_list(F.when(~whole, F.struct((-F.col("__deep")).alias("d"), "list_name", "__pos", "item", "category"))).alias("__inner")] if deep else []
    facts = met.groupBy(id_col).agg(*[F.max(F.when(whole, F.col(c))).alias(c) for c in carried], *[one(n) for n in names], *inner)
    if deep:
        free = F.transform(F.filter("__inner", lambda x: ~x["list_name"].startswith("banned")), lambda x: x["d"])
        facts = facts.withColumn("__deepest", F.array_min(F.filter("__inner", lambda x: x["list_name"].startswith("banned") & ~F.array_contains(free, x["d"]))))
    else:
        facts = facts.withColumn("__deepest", F.lit(None).cast("struct<d:int,list_name:string,__pos:int,item:string,category:string>"))
    if search is not None:
        found = search_verdicts(requests, id_col, search).filter(F.col("outcome").isin(*OUTCOMES[2:5]))
        facts = facts.join(found.select(id_col, F.col("reason").alias("__why"), F.col("categories").alias("__what")), id_col, "left")
    else:
        facts = facts.withColumns({"__why": none, "__what": none})
    c = lambda n: F.col(n).isNotNull()
    flag = {n: blanket(flags.get(n, []), F.col("__ip"), F.col("__ssl")) for n in names[:6]}
    grey = c("greysite") | c("greyurl") | flag["greysite"].isNotNull() | flag["greyurl"].isNotNull()
    category_of = lambda place, rules: F.coalesce(*[F.when(F.col(place) == r.ord, F.lit(r.category)) for r in rules], none)
    listed_as = lambda n: (F.coalesce(flag[n], F.col(f"{n}.item")), F.when(flag[n].isNull(), F.col(f"{n}.category")))
    held = lambda n: c(n) | flag[n].isNotNull()
    regex = ("banned expression", F.col("__br").cast("string"), category_of("__br", banned_regexes))
    chain: list[tuple[Column, str, Column, Column]] = [
        (c("bannedip"), "banned client", none, F.when(c("rooms"), "Banned Room").otherwise("Banned Client IP")),
        (F.col("__mode") == 0, "banned user", none, F.lit("Banned User")),
        (F.col("__own"), "own server", none, none),
        (F.col("__mode") == 2, "exception user", none, none),
        (c("exceptionip"), "exception client", none, none),
        (held("exceptionsite"), "exception site", *listed_as("exceptionsite")),
        (held("exceptionurl"), "exception url", *listed_as("exceptionurl")),
        (c("__er"), "exception expression", F.col("__er").cast("string"), none),
        (c("__why") & ~F.col("__ssl"), "search terms", F.col("__why"), F.col("__what")),
        (c("__br") & F.lit(regex_over_grey), *regex),
        (held("bannedsite") & ~grey, "banned site", *listed_as("bannedsite")),
        (held("bannedurl") & ~grey, "banned url", *listed_as("bannedurl")),
        (c("__br") & ~grey, *regex),
        (c("__hr") & ~grey, "banned header", F.col("__hr").cast("string"), category_of("__hr", header_regexes)),
        ((F.col("__deepest.list_name") == "bannedsite") & ~grey, "banned site", F.col("__deepest.item"), F.col("__deepest.category")),
        ((F.col("__deepest.list_name") == "bannedurl") & ~grey, "banned url", F.col("__deepest.item"), F.col("__deepest.category")),
    ]
    # a null item or category of the deciding rule must not fall through to the next one, so the place decides
    place = F.coalesce(*[F.when(test, F.lit(k)) for k, (test, *_) in enumerate(chain)], F.lit(-1))
    at = lambda of: F.coalesce(*[F.when(F.col("__place") == k, of(row)) for k, row in enumerate(chain)], none)
    code = F.coalesce(*[F.when(F.col("__place") == k, F.lit(CODES.get(row[1], 0))) for k, row in enumerate(chain)], F.lit(0))
    verdict = F.when(F.col("__place") < 0, "clean").when(F.col("__place") == 2, "own").when(F.col("__place").between(3, 7), "exception").otherwise("banned")
    return facts.withColumn("__place", place).select(id_col, verdict.alias("verdict"), code.alias("code"), at(lambda r: r[2]).alias("item"), at(lambda r: r[3]).alias("category"), F.col("rooms.category").alias("room"))


def rechecked(requests: DataFrame, id_col: str, rewrites: list[tuple[str, str]], items: DataFrame, ips: DataFrame, exception_regexes: list[Regex] = ()) -> DataFrame:
    """(id, url, code) of requests whose url the replacements change: the new url, and the exception it has now, else 0.

    Only sites, urls and expressions are looked at again, and none of them helps a banned address.
    """
    changed = requests.withColumn("__new", X.rewrite(F.col("url"), rewrites)).filter("__new <> url").withColumn("url", F.col("__new")).drop("__new")
    lists = items.filter("list_name IN ('exceptionsite', 'exceptionurl')")
    again = request_verdicts(changed, id_col, lists, ips.filter("list_name = 'bannedip'"), exception_regexes=exception_regexes)
    return changed.select(id_col, "url").join(again.select(id_col, F.when(F.col("verdict") == "exception", F.col("code")).otherwise(0).alias("code")), id_col)


def download_verdicts(responses: DataFrame, id_col: str, items: DataFrame, block_all: bool = False) -> DataFrame:
    """(id, verdict, code, item) of responses (id, url, mimetype, disposition, code).

    An exception site or type lets anything pass. Else a listed type and then a listed extension ban, with
    block_all anything is banned; an exception extension undoes both. Redirections and requests for
    authorisation are never judged.

    As for requests, all keys of a response and one that meets nothing go through one join with all rules, and
    what is left is partially aggregated and shuffled once.
    """
    names = ["bannedmimetype", "exceptionmimetype", "exceptionfilesite", "bannedextension", "exceptionextension"]
    tagged = lambda tag, c: F.coalesce(F.transform(c, lambda x: F.concat(F.lit(tag), x)), F.array().cast("array<string>"))
    looked = responses.select(id_col, "code", U.extension_source(F.col("url"), F.col("disposition"), F.col("mimetype")).alias("__name"), F.lower("mimetype").alias("__type"), L.site_key(F.col("url")).alias("__host"))
    parts = looked.select(id_col, "code", "__type", U.host_suffixes(F.col("__host")).alias("__sites"), extension_keys(F.col("__name")).alias("__ends"))
    own = F.concat(F.lit("-:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    keys = F.concat(tagged("s:", F.col("__sites")), tagged("e:", F.col("__ends")), F.when(F.col("__type").isNotNull(), F.array(F.concat(F.lit("m:"), "__type"))).otherwise(F.array().cast("array<string>")), F.array(own))
    facts = parts.select(id_col, "code", F.posexplode_outer(keys).alias("__pos", "__k"))
    kind = F.when(F.col("list_name").endswith("site"), "s:").when(F.col("list_name").endswith("extension"), "e:").otherwise("m:")
    rules = items.filter(F.col("list_name").isin(*names)).select("list_name", F.lower(F.trim("item")).alias("item")).distinct().withColumn("__k", F.concat(kind, "item"))
    met = facts.join(rules, "__k", "left").filter(F.col("__k").startswith("-:") | F.col("list_name").isNotNull())
    wide = met.groupBy(id_col).agg(F.max("code").alias("code"), *[F.min(F.when(F.col("list_name") == n, F.struct("__pos", "item")))["item"].alias(n) for n in names])
    c = lambda n: F.col(n).isNotNull()
    code = F.col("code")
    free = c("exceptionfilesite") | c("exceptionmimetype") | c("exceptionextension") | F.coalesce(((code >= 300) & (code < 400) & (code != 304)) | code.isin(401, 407), F.lit(False))
    kind = F.when(free, F.lit(0)).when(F.lit(block_all), CODES["blanket download"]).when(c("bannedextension"), CODES["banned extension"]).when(c("bannedmimetype"), CODES["banned type"]).otherwise(0)
    return wide.withColumn("__code", kind).select(
        id_col,
        F.when(F.col("__code") > 0, "banned").otherwise("clean").alias("verdict"),
        F.col("__code").alias("code"),
        F.when(F.col("__code") == CODES["banned extension"], F.col("bannedextension")).when(F.col("__code") == CODES["banned type"], F.col("bannedmimetype")).alias("item"),
    )


def upload_blocked(is_multipart: Column, length: Column, most: int) -> Column:
    """Whether an upload is above the limit: -1 none, 0 no uploads at all."""
    if most < 0:
        return F.lit(False)
    return F.coalesce(is_multipart & ((length > most) if most else F.lit(True)), F.lit(False))


def is_text(mimetype: Column) -> Column:
    return F.coalesce(mimetype.startswith("text") | (mimetype == "-"), F.lit(True))


def scan_gate(size: Column, ram_kib: int = 2000, disk_kib: int = 20_000) -> Column:
    """Where a body is held for a scan: "ram", "disk" or, beyond both, "unscanned"."""
    return F.when(size <= ram_kib * 1024, "ram").when(size <= disk_kib * 1024, "disk").otherwise("unscanned")


def cacheable(is_naughty: Column, is_bypass: Column, mimetype: Column, method: Column, code: Column) -> Column:
    """Whether a page may enter the cache of clean urls."""
    return F.coalesce(~is_naughty & ~is_bypass & is_text(mimetype) & (method == "GET") & (code == 200), F.lit(False))
