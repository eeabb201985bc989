"""Who a request belongs to: groups by user and address, rooms, banned clients, bypass tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.functions.text import md5_upper, mini_url_encode
from sieveline.operators.dedupe import repeated
from sieveline.operators.match import address_keys, ip_hits, range_keys

_RANK = lambda kind: F.when(kind == "ip", 0).when(kind == "subnet", 1).when(kind == "range", 2).otherwise(3)


def ip_groups(facts: DataFrame, ids: list[str], ip: Column, rules: DataFrame) -> DataFrame:
    """(ids, grp): an exact address comes before a subnet, that before a range; then the lowest group.

    Rows without a match don't come out.
    """
    hits = ip_hits(facts, ids, ip, rules.filter("kind <> 'host' AND grp IS NOT NULL"), ["kind", "grp"])
    return hits.groupBy(*ids).agg(F.min(F.struct(_RANK(F.col("kind")).alias("r"), "grp"))["grp"].alias("grp"))


def user_groups(facts: DataFrame, ids: list[str], user: Column, groups: DataFrame, default: int = 0) -> DataFrame:
    """(ids, filter_group) by the user, the default where there is none; of contradicting groups the lowest.

    groups: (user_name, grp) with grp from 1; filter_group is one less.
    """
    named = groups.filter("user_name IS NOT NULL AND grp IS NOT NULL").groupBy("user_name").agg((F.min("grp") - 1).alias("filter_group"))
    own = facts.select(*ids, user.alias("user_name"))
    return own.join(named, "user_name", "left").select(*ids, F.coalesce("filter_group", F.lit(default)).alias("filter_group"))


def rooms(facts: DataFrame, ids: list[str], ip: Column, host: Column, rules: DataFrame) -> DataFrame:
    """(ids, room): the first room by name with the address or the host."""
    by_ip = ip_hits(facts, ids, ip, rules.filter("kind <> 'host'"), ["room"])
    hosts = rules.filter("kind = 'host'").select(F.lower("host").alias("h"), "room").distinct()
    by_host = facts.select(*ids, F.lower(host).alias("h")).join(hosts, "h").select(*ids, "room")
    return by_ip.unionByName(by_host).groupBy(*ids).agg(F.min("room").alias("room"))


def listed_clients(facts: DataFrame, ids: list[str], ip: Column, host: Column, rules: DataFrame) -> DataFrame:
    """(ids) of facts whose address or host is on an address list."""
    by_ip = ip_hits(facts, ids, ip, rules.filter("kind <> 'host'"), [])
    hosts = rules.filter("kind = 'host'").select(F.lower("host").alias("h")).distinct()
    by_host = facts.select(*ids, F.lower(host).alias("h")).join(hosts, "h", "left_semi").select(*ids)
    return by_ip.unionByName(by_host).distinct()


def resolved_group(user_group: Column, ip_group: Column, default: int = 0) -> Column:
    """The first plugin's answer that is one: the user's group, else the address's, else the default."""
    return F.coalesce(user_group, ip_group, F.lit(default))


def groups_by_user_or_address(facts: DataFrame, id_col: str, user: str, ip: Column, named: DataFrame, rules: DataFrame, default: int = 0) -> DataFrame:
    """(id, grp): the user's group (named: user column, ug), else the best of the address's, else the default.

    Facts are read once: each makes the keys of its user and address and one that meets nothing, all in one join
    with both tables; what is left is partially aggregated and shuffled once. Facts without an id come out each.
    """
    keys = F.array(F.concat(F.lit("-:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.concat(F.lit("u:"), F.col(user)))
    spread = F.transform(address_keys(F.col("__n")), lambda x: F.concat(F.lit("n:"), x))
    every = F.concat(keys, F.coalesce(spread, F.array().cast("array<string>")))
    own = facts.select(id_col, user, ip.alias("__n")).select(id_col, user, "__n", F.explode_outer(every).alias("__k")).filter("__k IS NOT NULL")
    ranges = range_keys(rules.filter("kind <> 'host' AND grp IS NOT NULL"), ["kind", "grp", "lo", "hi"])
    of_users = named.select(F.concat(F.lit("u:"), F.col(user)).alias("__k"), F.lit(-1).alias("r"), F.col("ug").alias("grp"), F.lit(None).cast("long").alias("lo"), F.lit(None).cast("long").alias("hi"))
    every_rule = of_users.unionByName(ranges.select(F.concat(F.lit("n:"), "key").alias("__k"), _RANK(F.col("kind")).alias("r"), "grp", "lo", "hi"))
    met = own.join(every_rule, "__k", "left").filter(F.col("__k").startswith("-:") | (F.col("r").isNotNull() & (F.col("lo").isNull() | F.col("__n").between(F.col("lo"), F.col("hi")))))
    best = F.min(F.when(F.col("r").isNotNull(), F.struct("r", "grp")))["grp"]
    # facts that are equal in id, user and address are counted by the keys that meet nothing, and come out each
    found = met.groupBy(id_col, own[user], "__n").agg(F.coalesce(best, F.lit(default)).alias("grp"), F.count(F.when(F.col("__k").startswith("-:"), 1)).alias("__times"))
    return repeated(found.select(id_col, "grp", "__times"), "__times", "__copy").drop("__copy")


def bypass_token(url: Column, magic: str, ip: Column, expires: Column, user: Column | None = None) -> Column:
    """The url with its token: an upper-case MD5 and the expiry in seconds."""
    parts = [url, F.lit(magic), ip, expires.cast("string")] + ([user] if user is not None else [])
    mark = F.when(url.contains("?"), "&GBYPASS=").otherwise("?GBYPASS=")
    return F.concat(url, mark, md5_upper(*parts), expires.cast("string"))


def bypass_holds(url_with_token: Column, magic: str, ip: Column, now: Column) -> Column:
    """Whether a url carries a token for its own address and text that hasn't expired; false for none."""
    url = F.regexp_replace(url_with_token, "[?&]GBYPASS=.*$", "")
    token = F.regexp_extract(url_with_token, "[?&]GBYPASS=([0-9A-F]{32})(\\d+)$", 1)
    expires = F.regexp_extract(url_with_token, "[?&]GBYPASS=([0-9A-F]{32})(\\d+)$", 2)
    return F.coalesce((token != "") & (token == md5_upper(url, F.lit(magic), ip, expires)) & (expires.try_cast("bigint") >= now), F.lit(False))


def bypass_cookie(domain: Column, magic: str, ip: Column, expires: Column) -> Column:
    """The value of a bypass cookie for a domain: an upper-case MD5 and the expiry in seconds."""
    return F.concat(md5_upper(domain, F.lit(magic), ip, expires.cast("string")), expires.cast("string"))


def cookie_holds(cookie: Column, domain: Column, magic: str, ip: Column, now: Column) -> Column:
    """Whether a cookie is one for the domain, or for a domain above it, and the address, and hasn't expired."""
    expires = F.regexp_extract(cookie, "^[0-9A-F]{32}(\\d+)$", 1)
    hashed = F.left(cookie, F.lit(32))
    labels = F.split(domain, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    own = F.exists(above, lambda d: md5_upper(d, F.lit(magic), ip, expires) == hashed)
    return F.coalesce((expires != "") & own & (expires.try_cast("bigint") >= now), F.lit(False))


def scan_link(url: Column, magic: str, ip: Column, name: Column, mimetype: Column, disposition: Column) -> Column:
    """The url by which a client fetches a scanned download: hash, file name, type and encoded disposition."""
    coded = mini_url_encode(disposition)
    hashed = md5_upper(ip, url, name, mimetype, coded, F.lit(magic))
    whole = F.when(F.regexp_extract(url, "://(.*)$", 1).contains("/"), url).otherwise(F.concat(url, F.lit("/")))
    mark = F.when(whole.contains("?"), "&GSBYPASS=").otherwise("?GSBYPASS=")
    return F.concat(whole, mark, hashed, F.lit("&N="), name, F.lit("&M="), mimetype, F.lit("&D="), coded)


def scan_link_holds(link: Column, magic: str, ip: Column) -> Column:
    """Whether a link is one of scan_link for the address; false for any other url."""
    parts = r"^(.*)[?&]GSBYPASS=([0-9A-F]{32})&N=(.*?)&M=(.*?)&D=(.*)$"
    url, hashed, name, mimetype, coded = (F.regexp_extract(link, parts, k) for k in range(1, 6))
    same = lambda u: md5_upper(ip, u, name, mimetype, coded, F.lit(magic)) == hashed
    return F.coalesce((hashed != "") & (same(url) | same(F.regexp_replace(url, "/$", ""))), F.lit(False))


def reverse_names(facts: DataFrame, ids: list[str], ip: Column, dns: DataFrame) -> DataFrame:
    """(ids, name): the names of addresses by a table (ip, host), since no look-up can be made; several names come out each.

    Names are in lower case, without a final dot. Addresses without a name give no rows; null ones neither.
    """
    named = dns.filter("ip IS NOT NULL AND host IS NOT NULL").select("ip", F.regexp_replace(F.lower(F.trim("host")), r"\.$", "").alias("name")).filter("name <> ''").distinct()
    return facts.select(*ids, ip.alias("ip")).join(named, "ip").select(*ids, "name")
