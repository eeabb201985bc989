"""Matching hosts, urls, extensions, types and addresses against rule lists: equi joins on generated keys.

Facts keep their rows; what a matcher gives is a table of hits, which is small, so the wide rows of the facts
are never shuffled for a look-up. Rules are joined without hints: Spark broadcasts them by their size. Facts
with a null key match nothing; repeated facts and repeated rules come out once for each id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions import url as U
from sieveline.sources.lists import Regex, in_time


def _first(hits: DataFrame, ids: list[str], order: list[str], take: list[str]) -> DataFrame:
    """The hit that comes first in order, for each id."""
    best = F.min(F.struct(*order, *[c for c in take if c not in order])).alias("b")
    return hits.groupBy(*ids).agg(best).select(*ids, *[F.col(f"b.{c}") for c in take])


def _rules(rules: DataFrame, item: str) -> DataFrame:
    """(item, category): one row for each item, the first category by name."""
    return rules.groupBy(F.lower(F.trim(item)).alias("item")).agg(F.min("category").alias("category"))


def rules_now(facts: DataFrame, hits: DataFrame, ts: str, ids: list[str]) -> DataFrame:
    """Hits whose rule's time limit `tl` holds at the row's own time."""
    return hits.join(facts.select(*ids, ts), ids).filter(in_time(F.col("tl"), F.col(ts))).drop(ts)


def exact_hits(facts: DataFrame, ids: list[str], value: Column, rules: DataFrame) -> DataFrame:
    """(ids, item, category) of facts whose lowered value is an item."""
    keyed = facts.select(*ids, F.lower(value).alias("item"))
    return _first(keyed.join(_rules(rules, "item"), "item"), ids, ["item"], ["item", "category"])


def _hits_on_keys(keyed: DataFrame, ids: list[str], rules: DataFrame) -> DataFrame:
    # outer: else the optimizer would test the arrays before the explode, working their texts out once more
    exploded = keyed.select(*ids, F.posexplode_outer("__keys").alias("pos", "item"))
    return _first(exploded.join(_rules(rules, "item"), "item"), ids, ["pos", "item"], ["item", "category"])


def site_keys(facts: DataFrame, ids: list[str], host: Column) -> DataFrame:
    """(ids, __keys): the texts that an item of a site list can equal, nearest first."""
    return facts.select(*ids, host.alias("__host")).select(*ids, U.host_suffixes(F.col("__host")).alias("__keys"))


def url_keys(facts: DataFrame, ids: list[str], key: Column) -> DataFrame:
    """(ids, __keys): the texts that an item of a url list can equal, nearest first.

    For the host and each parent domain, the key cut at / ? & = and whole; a bare host has none, since url
    lists hold parts of sites. Built step by step, so that no step's text is worked out again in the next.
    """
    cut = facts.select(*ids, key.alias("__key")).select(*ids, F.regexp_extract("__key", "^([^/?]*)", 1).alias("__host"), F.regexp_extract("__key", "^[^/?]*(.*)$", 1).alias("__rest"))
    parts = cut.select(*ids, F.split("__host", r"\.").alias("__labels"), F.regexp_extract_all("__rest", F.lit("[/?&=][^/?&=]*"), F.lit(0)).alias("__pieces"))
    labels, pieces = F.col("__labels"), F.col("__pieces")
    both = parts.select(
        *ids,
        F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), ".")).alias("__hosts"),
        F.when(F.size(pieces) > 0, F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda k: F.array_join(F.slice(pieces, 1, k), ""))).otherwise(F.array().cast("array<string>")).alias("__cuts"),
    )
    cuts = F.col("__cuts")
    return both.select(*ids, F.flatten(F.transform("__hosts", lambda h: F.transform(cuts, lambda c: F.concat(h, c)))).alias("__keys"))


def site_hits(facts: DataFrame, ids: list[str], host: Column, rules: DataFrame) -> DataFrame:
    """(ids, item, category): the longest suffix of the host that is an item; ".tld" items hold for all of a top level."""
    return _hits_on_keys(site_keys(facts, ids, host), ids, rules)


def url_hits(facts: DataFrame, ids: list[str], key: Column, rules: DataFrame) -> DataFrame:
    """(ids, item, category): an item equals the list key or is followed in it by / ? & or =, for the host or a parent domain.

    The nearest domain's shortest item comes first.
    """
    return _hits_on_keys(url_keys(facts, ids, key), ids, rules)


def extension_keys(name: Column) -> Column:
    """The texts that an item of an extension list can equal, longest first; null for a name without a dot."""
    parts = F.split(F.regexp_extract(F.lower(name), r"([^/]*)$", 1), r"\.")
    n = F.size(parts)
    return F.when(n > 1, F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda k: F.concat(F.lit("."), F.array_join(F.slice(parts, k, n), "."))))


def extension_hits(facts: DataFrame, ids: list[str], name: Column, rules: DataFrame) -> DataFrame:
    """(ids, item, category): the longest list extension that a file name or path ends with, without regard to case."""
    return _hits_on_keys(facts.select(*ids, extension_keys(name).alias("__keys")), ids, rules)


def categorised(facts: DataFrame, ids: list[str], host: Column, key: Column, items: DataFrame, regexes: list[Regex] = ()) -> DataFrame:
    """(ids, category) by the lists for logging: of the site (logsite), else the url (logurl), else the first expression.

    One join of all keys with both lists and one shuffle; facts without a category don't come out.
    """
    looked = facts.select(*ids, host.alias("__h"), key.alias("__key"))
    looked = looked.select(*ids, U.host_suffixes(F.col("__h")).alias("__sites"), "__key", first_regex(F.col("__key"), list(regexes)).alias("__r"))
    keyed = url_keys(looked, [*ids, "__sites", "__r"], F.col("__key"))
    empty = F.array().cast("array<string>")
    tagged = lambda tag, c: F.coalesce(F.transform(c, lambda x: F.concat(F.lit(tag), x)), empty)
    named = F.coalesce(*[F.when(F.col("__r") == r.ord, F.lit(r.category)) for r in regexes], F.lit(None).cast("string"))
    # an expression's category is a key that meets nothing and is its own category
    last = F.when(named.isNotNull(), F.array(F.concat(F.lit("r:"), named))).otherwise(empty)
    rows = keyed.select(*ids, F.posexplode_outer(F.concat(tagged("s:", F.col("__sites")), tagged("u:", F.col("__keys")), last)).alias("__pos", "__k"))
    tag = F.when(F.col("list_name") == "logsite", "s:").otherwise("u:")
    rules = items.filter("list_name IN ('logsite', 'logurl')").groupBy(F.concat(tag, F.lower(F.trim("item"))).alias("__k")).agg(F.min("category").alias("category"))
    # the first item of a list decides, also where it has no category; then the next list is asked
    order = F.when(F.col("__k").startswith("s:"), 0).when(F.col("__k").startswith("u:"), 1).otherwise(2)
    first = lambda k: F.min(F.when((order == k) & F.col("__hit"), F.struct("__pos", "category")))["category"]
    known = rows.join(rules.withColumn("__hit", F.lit(True)), "__k", "left").withColumn("__hit", F.coalesce("__hit", F.col("__k").startswith("r:")))
    known = known.withColumn("category", F.when(F.col("__k").startswith("r:"), F.substring("__k", 3, 1 << 30)).otherwise(F.col("category"))).filter("__hit")
    return known.groupBy(*ids).agg(F.coalesce(first(0), first(1), first(2)).alias("category")).filter("category IS NOT NULL")


def first_regex(value: Column, rules: list[Regex], ts: Column | None = None) -> Column:
    """Place of the first pattern that is found in a text; null where none is. Patterns are literals, compiled once."""
    from sieveline.functions.text import java_pattern

    def holds(r: Regex) -> Column:
        found = value.rlike("(?is)" + java_pattern(r.pattern))
        if r.tl is None or ts is None:
            return found
        tl = F.struct(*[F.lit(x).alias(n) for x, n in zip(r.tl, ("sth", "stm", "enh", "enm", "days"))])
        return found & in_time(tl, ts)

    found = [F.when(holds(r), F.lit(r.ord)) for r in sorted(rules, key=lambda r: r.ord)]
    return F.coalesce(*found, F.lit(None).cast("int"))


def first_header_regex(headers: Column, rules: list[Regex]) -> Column:
    """Place of the first pattern that is found in any header line."""
    from sieveline.functions.text import java_pattern

    lines = F.transform(headers, lambda h: F.concat_ws(": ", h["name"], h["value"]))

    def holds(pattern: str) -> Column:
        return F.exists(lines, lambda x: x.rlike("(?is)" + java_pattern(pattern)))

    found = [F.when(holds(r.pattern), F.lit(r.ord)) for r in sorted(rules, key=lambda r: r.ord)]
    return F.coalesce(*found, F.lit(None).cast("int"))


#: A range over more than so many blocks of 256 addresses is looked up by its /8, a narrower one by its /24.
_WIDE = 256


def range_keys(rules: DataFrame, take: list[str]) -> DataFrame:
    """(taken columns, key): a row for each block that a rule's range touches, at most 256 for each rule."""
    lo, hi = F.col("lo"), F.col("hi")
    blocks = F.shiftright(hi, 8) - F.shiftright(lo, 8)
    keys = lambda bits: F.transform(F.sequence(F.shiftright(lo, bits), F.shiftright(hi, bits)), lambda b: F.concat(F.lit(f"{bits}:"), b.cast("string")))
    return rules.filter(lo <= hi).select(*take, F.explode(F.when(blocks < _WIDE, keys(8)).otherwise(keys(24))).alias("key"))


def address_keys(n: Column) -> Column:
    """The keys that an address meets range_keys by."""
    return F.array(*[F.concat(F.lit(f"{bits}:"), F.shiftright(n, bits).cast("string")) for bits in (8, 24)])


def ip_hits(facts: DataFrame, ids: list[str], ip: Column, rules: DataFrame, take: list[str]) -> DataFrame:
    """(ids, the taken columns of each rule) of every rule with lo <= ip <= hi.

    A range join as an equi join: each rule is spread over the blocks it touches (at most 256 rows each), each
    address has one key of either width, and the bounds are checked on what meets.
    """
    lo, hi, n = F.col("lo"), F.col("hi"), F.col("__n")
    keyed = range_keys(rules, ["lo", "hi", *take])
    own = facts.select(*ids, ip.alias("__n")).filter(n.isNotNull())
    own = own.withColumn("key", F.explode(address_keys(n)))
    return own.join(keyed, (own["key"] == keyed["key"]) & (n >= lo) & (n <= hi)).select(*ids, *take).distinct()


def embedded_urls(html: Column) -> Column:
    """Absolute urls in quotes, and the targets of href and src, without quotes; in order, repeats kept."""
    absolute = F.regexp_extract_all(html, F.lit("(?i)[\"']((?:https?|ftp)://[^\"']*)[\"']"), F.lit(1))
    linked = F.regexp_extract_all(html, F.lit("(?i)(?:href|src)\\s*=\\s*[\"']([^\"']*)[\"']"), F.lit(1))
    return F.concat(absolute, F.filter(linked, lambda u: ~u.rlike("(?i)^(?:https?|ftp)://")))


def page_links(html: Column, base: Column) -> Column:
    """Array of (url, relative) of embedded_urls, relative targets made absolute by the page's own url.

    A relative target is null where the page's url is; other protocols than those of embedded_urls are left out.
    """
    own = F.substring_index(base, "?", 1)
    folder = F.when(own.endswith("/"), own).otherwise(F.concat(own, F.lit("/")))
    root = F.regexp_extract(own, "(?i)^((?:[a-z]+://)?[^/]*)", 1)

    def link(u: Column) -> Column:
        absolute = u.rlike("(?i)^(?:https?|ftp)://")
        return F.struct(F.when(absolute, u).when(u.startswith("/"), F.concat(root, u)).otherwise(F.concat(folder, u)).alias("url"), (~absolute).alias("relative"))

    return F.transform(F.filter(embedded_urls(html), lambda u: u.rlike("(?i)^(?:https?|ftp)://") | ~u.contains("://")), link)


def plain_urls(text: Column) -> Column:
    """Absolute urls that stand in a text, quoted or not, without the punctuation that ends them; repeats kept."""
    return F.regexp_extract_all(text, F.lit("(?i)((?:https?|ftp)://[^ \\t\\r\\n\"'<>]*[^ \\t\\r\\n\"'<>.,;:!?)\\]])"), F.lit(1))


def banned_links(links: DataFrame, ids: list[str], url: str, items: DataFrame) -> DataFrame:
    """(ids, list_name, item, category) of links on the banned site list, else on the banned url list.

    Items of categories for advertisements ("ADs") don't count. ids must tell links apart.
    """
    from sieveline.functions.logfields import site_key

    of = lambda hits, name: hits.select(*ids, F.lit(name).alias("list_name"), "item", "category")
    rules = lambda name: items.filter(F.col("list_name") == name)
    sites = of(site_hits(links, ids, site_key(F.col(url)), rules("bannedsite")), "bannedsite")
    urls = of(url_hits(links, ids, U.list_key(F.col(url)), rules("bannedurl")), "bannedurl")
    both = sites.unionByName(urls).filter(~F.coalesce(F.col("category").contains("ADs"), F.lit(False)))
    return _first(both, ids, ["list_name"], ["list_name", "item", "category"])


def link_weights(pages: DataFrame, id_col: str, html: Column, base: Column, items: DataFrame, weight: int, mode: int = 1) -> DataFrame:
    """(id, weight, label) of pages with banned links: the weight for each, in mode 2 for each different item.

    Absolute and relative links are told apart in mode 2. label: the items in brackets, in order.
    """
    links = pages.select(id_col, F.posexplode_outer(page_links(html, base)).alias("place", "l")).select(id_col, "place", "l.url", "l.relative").filter("url IS NOT NULL")
    hits = banned_links(links, [id_col, "place", "relative"], "url", items).select(id_col, "place", "relative", "item")
    if mode == 2:
        hits = hits.groupBy(id_col, "relative", "item").agg(F.min("place").alias("place"))
    each = F.array_sort(F.collect_list(F.struct("place", "item")))
    return hits.groupBy(id_col).agg((F.count(F.lit(1)) * weight).alias("weight"), F.concat(F.lit("["), F.array_join(F.transform(each, lambda x: x["item"]), " "), F.lit("]")).alias("label"))


def deep_hits(requests: DataFrame, id_col: str, url: Column, items: DataFrame) -> DataFrame:
    """(id, pos, deep, list_name, item) of the first url within each url that is banned, by its site, else its url.

    Urls on an exception or grey list, of sites or urls, are passed over.
    """
    from sieveline.functions.logfields import site_key

    deep = requests.select(id_col, F.posexplode_outer(deep_urls(url)).alias("pos", "deep")).filter("deep IS NOT NULL")
    ids = [id_col, "pos", "deep"]
    keyed = {"site": site_keys(deep, ids, site_key(F.concat(F.lit("http://"), "deep"))), "url": url_keys(deep, ids, U.list_key(F.col("deep")))}
    found = []
    for kind, keys in keyed.items():
        rules = items.filter(F.col("list_name").isin(f"banned{kind}", f"grey{kind}", f"exception{kind}")).groupBy("list_name", F.lower(F.trim("item")).alias("item")).agg(F.lit(0).alias("__one"))
        found.append(keys.select(*ids, F.posexplode_outer("__keys").alias("__at", "item")).join(rules.drop("__one"), "item").select(*ids, "list_name", "__at", "item"))
    free = ~F.col("list_name").startswith("banned")
    each = found[0].unionByName(found[1]).groupBy(*ids).agg(F.max(free).alias("__free"), F.min(F.when(~free, F.struct("list_name", "__at", "item"))).alias("b")).filter("NOT __free")
    return each.groupBy(id_col).agg(F.min(F.struct("pos", "deep", "b")).alias("f")).select(id_col, "f.pos", "f.deep", "f.b.list_name", "f.b.item")


def deep_urls(url: Column) -> Column:
    """Urls within a url: what follows each ":" after the protocol, without leading ":" and "/"."""
    from sieveline.functions.text import after, percent_decode

    rest = F.split(percent_decode(after(url, "://")), ":")
    n = F.size(rest)
    tails = F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda k: F.regexp_replace(F.array_join(F.slice(rest, k, n), ":"), "^[:/]+", ""))
    return F.when(n > 1, F.filter(tails, lambda x: x != "")).otherwise(F.array().cast("array<string>"))


def any_of(*tests: Column) -> Column:
    """True if any test is true; nulls count as false."""
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])


def blanket(flags: list[str], is_ip: Column, is_ssl: Column) -> Column:
    """The flag of a list by which everything of a request's kind is banned: all, addresses, SSL, or both; null for none."""
    tests = [("**", F.lit(True)), ("*ip", is_ip), ("**s", is_ssl), ("*ips", is_ip & is_ssl)]
    return F.coalesce(*[F.when(test, F.lit(flag)) for flag, test in tests if flag in flags], F.lit(None).cast("string"))


def own_server(url: Column, deny_host: str, reporting_level: int) -> Column:
    """Whether a url is the deny address itself, which only levels 1 and 2 use."""
    if reporting_level not in (1, 2):
        return F.lit(False)
    host = F.regexp_extract(F.lower(F.trim(url)), "^(?:[a-z]+://)?([^/]*)", 1)
    return F.coalesce(host.startswith(deny_host), F.lit(False))


def first_manager(user_agent: Column, mimetype: Column, extension: Column, managers: list[tuple[str, str | None, list[str], list[str]]]) -> Column:
    """Name of the first manager that takes a download, the last one's by default.

    managers: (name, user-agent pattern or null for any, types, extensions); a manager with lists takes what is
    on one of them, one without lists takes everything.
    """
    if not managers:
        raise ValueError("there must be a manager")

    def takes(pattern: str | None, types: list[str], extensions: list[str]) -> Column:
        agent = F.lit(True) if pattern is None else user_agent.rlike(pattern)
        if not types and not extensions:
            return agent
        return agent & any_of(F.lower(mimetype).isin(*types) if types else F.lit(False), F.lower(extension).isin(*extensions) if extensions else F.lit(False))

    return F.coalesce(*[F.when(any_of(takes(p, t, e)), F.lit(name)) for name, p, t, e in managers], F.lit(managers[-1][0]))
