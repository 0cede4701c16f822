"""Social profiles: one canonical form per platform, as column expressions.

``with_profile`` adds a struct (value, key, handle), null for urls that name no
profile: share and login links, videos, posts, searches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawlkit.functions import rules
from trawlkit.functions.rules import EDGE, LOW, java, some
from trawlkit.functions.session import per_session
from trawlkit.functions.text import unescape_basic
from trawlkit.functions.urls import SCHEME



_FACEBOOK = "https://www.facebook.com/"


@dataclass
class Parts:
    """A url cut up: host without www., m. and mobile., path segments, query."""

    host: Column
    segs: Column
    query: Column

    def seg(self, n: int) -> Column:
        return F.get(self.segs, F.lit(n))

    def low(self, n: int) -> Column:
        return F.lower(F.coalesce(self.seg(n), F.lit("")))

    def has(self, n: int) -> Column:
        return F.size(self.segs) >= n

    def param(self, name: str) -> Column:
        """First value of a query parameter, decoded; null where absent."""
        raw = F.regexp_extract(F.concat(F.lit("&"), self.query), f"&{name}=([^&]*)", 1)
        return F.when(F.concat(F.lit("&"), self.query).rlike(f"&{name}="), F.coalesce(F.try_url_decode(raw), raw))

    def on(self, *domains: str) -> Column:
        hit = F.lit(False)
        for d in domains:
            hit = hit | (self.host == d) | self.host.endswith("." + d)
        return hit


def url_parts(url: Column) -> Column:
    """A url cut up, as a struct; make it a column of its own before :func:`canonical` reads it many times."""
    rest = F.regexp_replace(unescape_basic(F.trim(url)), SCHEME, "")
    host = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_extract(rest, "^([^/?#]*)", 1), "^[^@]*@", ""), r":\d*$", ""))
    host = F.regexp_replace(host, r"^(?:(?:www|mobile|m)\.)+(?=.)", "")
    segs = F.filter(F.split(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), "/"), lambda s: s != "")
    return F.struct(host.alias("host"), segs.alias("segs"), F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1).alias("query"))


def _parts(cut: Column) -> Parts:
    return Parts(cut["host"], cut["segs"], cut["query"])


def redirect_target(cut: Column, url: Column) -> Column:
    """The target of an outbound redirect link (``l.php?u=``), else the url; null where the target is missing."""
    p = _parts(cut)
    return F.when(p.host.endswith("facebook.com") & (p.low(0) == "l.php"), F.when(p.param("u") != "", p.param("u"))).otherwise(url)


def _hit(value, key, handle) -> Column:
    return F.struct(value.alias("value"), key.alias("key"), handle.alias("handle"))


def _prefixed(prefix: str, x: Column) -> Column:
    return F.concat(F.lit(prefix), x)


def _profile(prefix: str, user: Column) -> Column:
    return _hit(_prefixed(prefix, user), F.lower(user), user)


def _full(x: Column, pattern: str) -> Column:
    return x.rlike(rf"(?i)^(?:{pattern})\z")


def _no_dots(x: Column) -> Column:
    return F.regexp_replace(x, r"\.+$", "")


def _kept(platform: str, first: Column) -> Column:
    return ~F.lower(first).isin(*rules.DROPPED_PATHS[platform])


def _linkedin(p: Parts):
    kind = p.low(0)
    return p.on("linkedin.com") & p.has(2) & kind.isin("in", "company", "school"), _hit(F.concat(F.lit("https://www.linkedin.com/"), kind, F.lit("/"), p.seg(1)), F.concat(kind, F.lit("/"), p.low(1)), p.seg(1))


def _twitter(p: Parts):
    user = F.regexp_replace(p.seg(0), "^@+", "")
    return p.on("x.com", "twitter.com") & _kept("twitters", user) & _full(user, "[a-z0-9_]{1,15}"), _profile("https://x.com/", user)


def _instagram(p: Parts):
    user = _no_dots(F.when(p.low(0) == "stories", p.seg(1)).otherwise(p.seg(0)))
    return p.on("instagram.com", "instagr.am") & _kept("instagrams", p.seg(0)) & _full(user, "[a-z0-9_.]{2,30}"), _profile("https://www.instagram.com/", user)


def _facebook(p: Parts):
    first, user, number = p.low(0), _no_dots(p.seg(0)), p.param("id")
    named = first.isin("people", "pages")
    found = (
        F.when(first.startswith("share") | first.isin(*rules.DROPPED_PATHS["facebooks"]), F.lit(None))
        .when(first == "profile.php", F.when(_full(number, r"\d+"), _hit(_prefixed(_FACEBOOK + "profile.php?id=", number), _prefixed("id/", number), number)))
        .when(first.endswith(".php"), F.lit(None))
        .when(named, F.when(_full(p.seg(2), r"\d+"), _hit(F.concat(F.lit(_FACEBOOK), first, F.lit("/"), p.seg(1), F.lit("/"), p.seg(2)), F.concat(first, F.lit("/"), p.seg(2)), p.seg(1))))
        .when(_full(user, "[a-z0-9.]{5,51}"), _profile(_FACEBOOK, user))
    )
    return p.on("facebook.com", "fb.com") & p.has(1), found


def _youtube(p: Parts):
    kind, second, name = p.low(0), p.seg(1), F.substring(p.seg(0), 2, 1 << 20)
    found = (
        F.when(p.seg(0).rlike("^@."), _hit(_prefixed("https://www.youtube.com/@", name), _prefixed("@", F.lower(name)), name))
        .when((kind == "channel") & p.has(2), _hit(_prefixed("https://www.youtube.com/channel/", second), _prefixed("channel/", second), second))
        .when(kind.isin("c", "user") & p.has(2), _hit(F.concat(F.lit("https://www.youtube.com/"), kind, F.lit("/"), second), F.concat(kind, F.lit("/"), F.lower(second)), second))
    )
    return p.on("youtube.com") & p.has(1), found


def _tiktok(p: Parts):
    user = _no_dots(F.substring(p.seg(0), 2, 1 << 20))
    return p.on("tiktok.com") & p.seg(0).startswith("@") & (user != ""), _profile("https://www.tiktok.com/@", user)


def _pinterest(p: Parts):
    user = _no_dots(p.seg(0))
    return F.array_contains(F.split(p.host, r"\."), "pinterest") & _kept("pinterests", user) & _full(user, r"[a-z0-9\-_.]+"), _profile("https://www.pinterest.com/", user)


def _discord(p: Parts):
    host = F.regexp_replace(F.regexp_replace(p.host, r"^canary\.", ""), r"^ptb\.", "")
    own = Parts(F.when(host == "discordapp.com", "discord.com").otherwise(host), p.segs, p.query)
    code = F.when(p.low(0) == "invite", p.seg(1)).otherwise(p.seg(0))
    found = F.when(p.low(0) == "users", F.when(_full(p.seg(1), r"\d+"), _hit(_prefixed("https://discord.com/users/", p.seg(1)), _prefixed("users/", p.seg(1)), p.seg(1)))).when(
        _full(code, r"[a-z0-9\-_]{2,50}"), _hit(_prefixed("https://discord.gg/", code), _prefixed("invite/", code), code)
    )
    return own.on(*(f"discord.{t}" for t in ("com", "gg", "io", "li", "me"))) & p.has(1) & _kept("discords", p.seg(0)), found


def _snapchat(p: Parts):
    user = _no_dots(F.when(p.seg(0).rlike("^@."), F.substring(p.seg(0), 2, 1 << 20)).when(p.low(0) == "add", p.seg(1)))
    return p.on("snapchat.com") & _full(user, some(LOW + r"\-_.", "3,32")), _profile("https://www.snapchat.com/add/", user)


def _threads(p: Parts):
    bare = F.regexp_replace(p.seg(0), "^@+", "")
    user = _no_dots(bare)
    return p.on("threads.net", "threads.com") & _kept("threads", bare) & _full(user, "[a-z0-9_.]{2,30}"), _profile("https://www.threads.net/@", user)


def _telegram(p: Parts):
    preview = p.low(0) == "s"
    first = F.when(preview, p.seg(1)).otherwise(p.seg(0))
    # an invitation's code follows the segment that says so, previewed or not
    found = (
        F.when(F.lower(first) == "joinchat", F.when(p.has(2), _hit(_prefixed("https://t.me/joinchat/", p.seg(1)), _prefixed("joinchat/", p.seg(1)), p.seg(1))))
        .when(first.rlike(r"^\+."), _hit(_prefixed("https://t.me/", first), first, F.substring(first, 2, 1 << 20)))
        .when(_full(first, "[a-z0-9_]{5,32}"), _profile("https://t.me/", first))
    )
    return p.on("t.me", "telegram.me", "telegram.dog") & _kept("telegrams", p.seg(0)) & _kept("telegrams", first), found


def _reddit(p: Parts):
    name = p.seg(1)
    found = F.when(p.low(0).isin("u", "user") & _full(name, r"[a-z0-9\-_]{3,20}"), _hit(_prefixed("https://www.reddit.com/user/", name), _prefixed("user/", F.lower(name)), name)).when(
        (p.low(0) == "r") & _full(name, "[a-z0-9_]{2,21}"), _hit(_prefixed("https://www.reddit.com/r/", name), _prefixed("r/", F.lower(name)), name)
    )
    return p.on("reddit.com") & p.has(2), found


def _whatsapp(p: Parts):
    direct = F.regexp_replace(p.seg(0), r"^\++", "")
    sent = F.regexp_replace(p.param("phone"), r"\D", "")
    code = F.when(p.seg(0) == "invite", p.seg(1)).otherwise(p.seg(0))
    number = lambda d: F.when(_full(d, "[0-9]{7,15}"), _hit(_prefixed("https://wa.me/", d), _prefixed("wa.me/", d), d))
    found = (
        F.when(p.host == "wa.me", number(direct))
        .when(p.host == "chat.whatsapp.com", F.when(_full(code, "[a-z0-9]{16,32}"), _hit(_prefixed("https://chat.whatsapp.com/", code), _prefixed("chat/", code), code)))
        .when(p.on("whatsapp.com") & (F.size(p.segs) == 1) & (p.low(0) == "send"), number(sent))
    )
    return p.has(1), found


def _github(p: Parts):
    owner = F.when(p.low(0) == "orgs", p.seg(1)).otherwise(p.seg(0))
    return p.on("github.com") & _kept("githubs", owner) & _full(owner, EDGE + some(LOW + r"\-", "0,38")), _profile("https://github.com/", owner)


def _bluesky(p: Parts):
    handle = _no_dots(p.low(1))
    return p.on("bsky.app") & (p.low(0) == "profile") & _full(handle, EDGE + some(LOW + r".:\-", "1,255")), _profile("https://bsky.app/profile/", handle)


def _medium(p: Parts):
    sub = F.regexp_replace(p.host, r"\.medium\.com$", "")
    user = _no_dots(F.substring(p.seg(0), 2, 1 << 20))
    own = p.host.endswith(".medium.com")
    found = F.when(own, F.when(_full(sub, r"[a-z0-9\-]{2,50}"), _hit(F.concat(F.lit("https://"), sub, F.lit(".medium.com")), sub, sub))).when(p.seg(0).rlike("^@..") & _full(user, r"[a-z0-9_.\-]{2,50}"), _profile("https://medium.com/@", user))
    return p.on("medium.com"), found


def _calendly(p: Parts):
    first, code = p.seg(0), p.seg(1)
    found = F.when(p.low(0) == "d", F.when(_full(code, r"[a-z0-9\-]{3,30}"), _hit(_prefixed("https://calendly.com/d/", code), _prefixed("d/", F.lower(code)), code))).when(_full(first, r"[a-z0-9_\-]{2,60}"), _profile("https://calendly.com/", first))
    return p.on("calendly.com") & _kept("calendlys", first), found


_FORMS = dict(zip(rules.PLATFORMS, (_linkedin, _twitter, _instagram, _facebook, _youtube, _tiktok, _pinterest, _discord, _snapchat, _threads, _telegram, _reddit, _whatsapp, _github, _bluesky, _medium, _calendly)))


def canonical(platform: str, cut: Column) -> Column:
    """The profile that a url, given as :func:`url_parts`, names on ``platform``."""
    fits, found = _FORMS[platform](_parts(cut))
    return F.when(fits, found)


def _any_canonical(x: Column) -> Column:
    found = F
    for p in rules.PLATFORMS:
        found = found.when(x["platform"] == p, canonical(p, x["_cut"]))
    return found.otherwise(F.lit(None))


@per_session
def _canonical_of_any() -> Column:
    # seventeen forms in one generated method are more than the compiler takes; a lambda is evaluated as it is
    return F.get(F.transform(F.array(F.struct(F.col("_platform").alias("platform"), "_cut")), _any_canonical), F.lit(0))


def with_profile(df: DataFrame, platform: str | Column, url: str = "value", name: str = "profile") -> DataFrame:
    """``df`` with the canonical profile of column ``url``; redirects are followed twice.

    Each step is a projection of its own, so that what the next step reads many
    times is computed once. Filter on the result by exploding it, see
    :func:`only_profiles`: a predicate would be pushed below and copied into
    every step.
    """
    df = df.withColumn("_to", F.col(url))
    for _ in range(2):
        df = df.withColumn("_cut", url_parts(F.col("_to"))).withColumn("_to", redirect_target(F.col("_cut"), F.col("_to")))
    df = df.withColumn("_cut", url_parts(F.col("_to")))
    if isinstance(platform, str):
        found = canonical(platform, F.col("_cut"))
    else:
        df = df.withColumn("_platform", platform)
        found = _canonical_of_any()
    return df.withColumn(name, found).drop("_to", "_cut", "_platform")


def only_profiles(df: DataFrame, name: str = "profile") -> DataFrame:
    """Rows whose profile is not null, without a predicate (see :func:`with_profile`)."""
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.explode(F.when(F.col(name).isNotNull(), F.array(name))).alias(name))


#: Number that a messaging link dials.
_DIALLED = java(r"(?:wa\.me/\+*|whatsapp\.com/send/?\?(?:[^#]*&)?phone=(?:\+|%2B)*)([0-9]{7,15})(?:[/?#&]|$)")


def dialled_number(url: Column) -> Column:
    """``+digits`` of a messaging link, null for others."""
    found = F.regexp_extract(unescape_basic(url), _DIALLED, 1)
    return F.when(found != "", F.concat(F.lit("+"), found))


def vendor_credit(handle: Column, label: Column) -> Column:
    """A site builder's own profile on somebody else's site."""
    low = F.lower(handle)
    return low.isin(*rules.VENDORS) & ~low.eqNullSafe(label)


def detected(html: Column, platform: str) -> Column:
    """Raw matches of a platform's pattern, then those after undoing escaped slashes."""
    pattern = F.lit(java(rules.PLATFORM_PATTERN[platform]))
    return F.concat(F.regexp_extract_all(html, pattern, F.lit(0)), F.when(html.contains("\\/"), F.regexp_extract_all(F.replace(html, F.lit("\\/"), F.lit("/")), pattern, F.lit(0))).otherwise(F.array().cast("array<string>")))


def social_bonus_exact(handle: Column, label: Column) -> Column:
    """4 for the site's own name, 2 if one holds the other, null where only likeness can tell."""
    h = F.regexp_replace(F.lower(F.coalesce(handle, F.lit(""))), "[^a-z0-9]", "")
    return F.when((h == "") | (F.coalesce(label, F.lit("")) == ""), 0).when(h == label, 4).when(label.contains(h) | h.contains(label), 2)
