"""Rule tables: platforms, keywords, weights and the patterns that detect contacts.

Patterns are written for both Java (Spark) and Python, where ``ASCII`` classes
are meant; :func:`java` adds the case flag that Java reads as ASCII-only.
"""

from __future__ import annotations

PAGE_WEIGHT = {"homepage": 5, "contact": 4, "about": 3, "other": 1}
HOMEPAGE_BONUS, FOOTER_BONUS, HREF_BONUS, REGION_BONUS = 3, 2, 2, 2
SOURCES_SHOWN = 10
SCAN_CHARS, STORED_CHARS = 1_500_000, 3_000_000
LONG_TOKEN = 320

#: The order is the order of the output columns.
PLATFORMS = tuple("linkedins twitters instagrams facebooks youtubes tiktoks pinterests discords snapchats threads telegrams reddits whatsapps githubs blueskys mediums calendlys".split())
ANCHOR_ONLY = frozenset({"githubs"})

GENERIC_LOCALS = tuple(sorted({"admin", "contact", "hello", "hi", "info", "mail", "office", "sales", "support", "team"}))
FREE_MAIL = tuple(sorted({"aol", "gmail", "gmx", "hotmail", "icloud", "live", "msn", "outlook", "proton", "protonmail", "yahoo"}))
FREE_MAIL_DOMAINS = ("web.de",)
#: Hosted site builders; their own profiles show up on their customers' pages.
VENDORS = tuple(sorted("bigcommerce duda elementor godaddy jimdo prestashop shopify shopifyplus squarespace strikingly webflow weebly wix wixstudio woocommerce wordpress wordpressdotcom".split()))


def java(pattern: str) -> str:
    return "(?i)" + pattern


# composing patterns


def _alt(*options: str) -> str:
    return f"(?:{'|'.join(options)})"


def _opt(*parts: str) -> str:
    return f"(?:{''.join(parts)})?"


def some(chars: str, count: str = "1,") -> str:
    return f"[{chars}]{{{count}}}"


def _no(what: str) -> str:
    return f"(?!{what})"


LOW, _ANY, _NUM = "a-z0-9", "a-zA-Z0-9", "0-9"
_WWW = _opt(r"www\.")

# e-mail

_ATOM = some(LOW + "~}|{`_?^=/+*'&%$#!-")
#: Control characters that mail allows unescaped, and escaped.
_CONTROL = r"\x01-\x08\x0b\x0c"
_ESCAPED = rf"\\[\x01-\x09{_CONTROL[9:]}\x0e-\x7f]"
_QUOTED = '"' + _alt(rf"[{_CONTROL}\x0e-\x1f!#-\[\]-\x7f]", _ESCAPED) + '*"'
EDGE = f"[{LOW}]"
_LABEL = EDGE + _opt(some(LOW + "-", "0,"), EDGE)
_OCTET = _alt("25[0-5]", "2[0-4]" + some(_NUM, "1"), f"[01]?{some(_NUM, '1')}{some(_NUM, '0,1')}")
_LITERAL_TAIL = some(LOW + "-", "0,") + EDGE + ":" + _alt(rf"[{_CONTROL}\x0e-\x1f!-Z\x53-\x7f]", _ESCAPED) + "+"
_DOTTED = _opt(r"\.", _ATOM)[:-1] + "*"
_HOST = _alt(_LABEL + r"\.") + "+" + _LABEL
EMAIL = _alt(_ATOM + _DOTTED, _QUOTED) + "@" + _alt(_HOST, r"\[" + _alt(_OCTET + r"\.") + "{3}" + _alt(_OCTET, _LITERAL_TAIL) + r"\]")
#: The same without quoted local parts and address literals, which RE2 and Java read alike.
EMAIL_PLAIN = f"{_ATOM}{_DOTTED}@{_HOST}"
ASSET_TAIL = r"\.(?:css|gif|ico|jpe?g|js|png|svg|webp)$"
PLACEHOLDER_DOMAINS = tuple(sorted({"company.com", "domain.com", "email.com", "example.com", "mysite.com", "sentry-next.wixpress.com", "sentry.io", "yourdomain.com"}))
MAILTO = r"^mailto:"
LOOKALIKES = {"＠": "@", "﹫": "@", "．": ".", "。": ".", "․": "."}

# phone

TEL = r"^(?:callto|phone|telephone|tel):/?/?"


def _joined(sep: str, *digits: str) -> str:
    return sep.join(f"[0-9]{{{d}}}" for d in digits)


_PHONE_SHAPES = [
    _joined("", "6,15"),
    _opt(some(_NUM, "1,4"), " ?") + rf"\({some(_NUM, '2,4')}\) ?{some(_NUM, '2,4')}(?: ?(?:-|.)?) ?{some(_NUM, '2,6')}",
    rf"\({some(_NUM, '2')}\) ?" + _joined("-", "4,5", "4"),
    *(_joined(sep, *["2,4"] * n, "2,6") for sep in ("-", r"\.") for n in (3, 2, 1)),
    _joined(" ", "2,4", "2,4", "2,4", "2,6"),
    _joined(" ", "2,4", "2,4", "2,6"),
    _joined(" ", "2,4", "3,8"),
]
PHONE = "(?:" + "|".join(r"(?:00|\+)?" + s for s in _PHONE_SHAPES) + ")"
PHONE_DIGITS = (7, 15)
ISO_DATE = f"^{_joined('-', '4', '2', '2')}$"
_YEAR = r"(?:19|20)\d{2}"
DAY_DATE = r"(?<!\d)" + 2 * r"\d{1,2}[./]" + _YEAR + _no(r"\d")
#: Shapes of numbers that are not phones: year ranges, decimals, addresses, model years, long ids, padded ids.
PHONE_JUNK = (f"^{_YEAR}{_opt('[ .-]', _YEAR)}$", f"^{some(_NUM, '1,3')}[.]{some(_NUM, '4,')}$", f"^{some(_NUM, '1,3')}(?:[.]{some(_NUM, '1,3')}){{3}}$", f"^{some(_NUM, '2,4')} {_YEAR}$", "^0{3,}", f"^{some(_NUM, '12,15')}$")
_REGISTERS = "abn acn company cvr ein gst hrb kvk mwst registration reg siren siret tax uid ust-idnr ust vat".split()
REGISTER_LABEL = r"\b(?i:" + "|".join(_REGISTERS) + r")[.:]?\s*(?i:id|no|nr|number)?[.:]?\s*(?:[A-Z]{2,3})?$"
REGISTER_REACH = 28

# platforms

_START, _HTTP = r"(?<!\w)", r"(?:https?://)?"
_SLASH = "/?"


def _not_reserved(words: str) -> str:
    return "(?!(?:" + "|".join(sorted(words.split())) + r")(?:['\"?./]|$))"


TWITTER_RESERVED = "account compose explore hashtag home i intent login messages notifications oauth oct privacy search settings share signup start tos widgets"
_FACEBOOK_RESERVED = r"ad_campaign ads ajax apps bookmarks business chat common connect crisisresponse developers dyi events friends fundraisers games gaming groups help images intern jobs l\.php live login marketplace messages offers onthisday pages people photo.php plugins policies recommendations recover reg rsrc\.php salesgroups saved security settings sharer weather"
GITHUB_RESERVED = "about account apps blog codespaces collections contact copilot customer-stories discussions enterprise enterprises events explore features git-guides issues join login marketplace mobile new notifications organizations premium-support pricing pulls readme resources search security sessions settings signup site solutions sponsors team topics trending"
CALENDLY_RESERVED = "api app blog careers customers event_types features help integrations legal login newsletter press pricing resources security signup solutions teams"
_TELEGRAM_RESERVED = "addemoji addstickers bg confirmphone iv login proxy s setlanguage share socks"
_THREADS_RESERVED = "about activity explore login privacy search settings t terms"


def _handle(chars: str, count: str) -> str:
    """A handle of ``count`` such characters, and no more of them after it."""
    return f"(?:[{chars}]{{{count}}})(?![{chars}])"


_ID = some(_NUM, "2,50")
_TOKEN = some(_ANY + "_-", "10,64")
_PIN_USER = some(LOW + r"\-_\.")
_DISCORD_HOSTS = _alt(r"discord\." + _alt("com", "gg", "io", "li", "me"), r"discordapp\.com")
_CANARY = _opt(_alt("canary", "ptb"), ".")
_BODIES = {
    "linkedins": _opt("[a-z]+", r"\.") + r"linkedin\.com/" + _alt("company", "in") + "/" + _handle(LOW + r"\-_%=", "2,60") + _SLASH,
    "instagrams": _WWW + _alt(r"instagr\.am", r"instagram\.com") + "/" + _no("_n|_u|explore") + _handle(LOW + "_.", "2,30") + _SLASH,
    "twitters": _opt("www.") + _alt("x.com", "twitter.com") + "/" + _not_reserved(TWITTER_RESERVED) + _handle(LOW + "_", "1,15") + _SLASH,
    "facebooks": _opt("www.") + _alt("fb.com", "facebook.com") + "/" + _not_reserved(_FACEBOOK_RESERVED) + _alt(r"profile\.php\?id=" + some(_NUM, "3,20"), _no(r"profile\.php") + some(LOW + ".", "5,51")) + _no(f"[{LOW}.]") + _SLASH,
    "youtubes": _alt(r"youtu\.be/", _opt(_alt(r"m\.", r"www\.")) + r"youtube\.com" + _opt("/", _alt("c" + _opt("hannel"), "embed", "user", "v", "watch"), _opt(r"\.php")) + _alt(r"\?[^ ]*v=", "/")) + some(_ANY + r"\-_@", "2,100"),
    "tiktoks": _opt(_alt("m", "www"), r"\.") + r"tiktok\.com/" + _alt(_alt("embed", "trending", "v") + _alt("/", r"\?shareId=") + _ID + _no(f"[{_NUM}]"), "@" + some(LOW + r"\-_\.") + _opt("/video/", _ID, _no(f"[{_NUM}]"))) + _SLASH,
    "pinterests": _alt(_WWW + "pinterest" + _alt(r"\.com", _alt(r"\." + some("a-z", "2")) + "{1,2}"), some("a-z", "2") + r"\.pinterest\.com") + "/" + _alt("pin/" + _ID, _no("pin") + _PIN_USER + _opt("/", _PIN_USER)) + _SLASH,
    "discords": _WWW + _alt(_CANARY + "discord" + _opt("app") + r"\.com/channels/" + _ID + _opt("/", _ID)[:-1] + "*", _CANARY + _DISCORD_HOSTS + _opt("/invite") + "/" + _no("channels") + some(LOW + r"\-_", "2,50")) + _SLASH,
    "snapchats": _WWW + r"snapchat\.com/" + _alt("@", "add/") + _handle(LOW + r"\-_.", "3,32") + _SLASH,
    "threads": _WWW + r"threads\." + _alt("com", "net") + "/" + _not_reserved(_THREADS_RESERVED) + "@?" + _handle(LOW + "_.", "2,30") + _SLASH,
    "telegrams": _WWW + _alt(r"t\.me", r"telegram\." + _alt("dog", "me")) + "/" + _opt("s/") + _not_reserved(_TELEGRAM_RESERVED) + _alt("joinchat/" + _TOKEN, r"\+" + _TOKEN, some(LOW + "_", "5,32")) + _no(f"[{_ANY}_-]") + _SLASH,
    "reddits": _opt(_alt("m", "np", "old", "www"), r"\.") + r"reddit\.com/" + _alt("u" + _opt("ser") + "/" + some(LOW + r"\-_", "3,20"), "r/" + some(LOW + "_", "2,21")) + _no(rf"[{LOW}\-_]") + _SLASH,
    "whatsapps": _alt(r"wa\.me/" + some(_NUM, "7,15"), _alt("api", "web") + r"\.whatsapp\.com/send/?\?" + "[^ '\"<>]*" + r"phone=\+?" + some(_NUM, "7,15"), r"chat\.whatsapp\.com/" + _opt("invite/") + some(_ANY, "16,32")) + _no(f"[{_ANY}]"),
    "githubs": _WWW + r"github\.com/" + _not_reserved(GITHUB_RESERVED) + _opt("orgs/") + EDGE + _handle(LOW + r"\-", "0,38") + _SLASH,
    "blueskys": _WWW + r"bsky\.app/profile/" + EDGE + _handle(LOW + r".:\-", "1,255") + _SLASH,
    "mediums": _alt(_WWW + r"medium\.com/@" + some(LOW + r"_.\-", "2,50"), _no(r"www\.") + some(LOW + r"\-", "2,50") + r"\.medium\.com") + _no(rf"[{LOW}_.\-]") + _SLASH,
    "calendlys": _WWW + r"calendly\.com/" + _not_reserved(CALENDLY_RESERVED) + _handle(LOW + r"_\-", "2,60") + _SLASH,
}
PLATFORM_PATTERN = {p: _START + _HTTP + _BODIES[p] for p in PLATFORMS}

#: Cheap tests on lower-cased html; a page that fails one cannot match the platform's pattern.
GATES = {
    "linkedins": r"linkedin\.com", "instagrams": r"instagr(?:am\.com|\.am)", "twitters": "(?:x|twitter).com", "facebooks": "(?:fb|facebook).com", "youtubes": r"youtu(?:\.be|be\.com)", "tiktoks": r"tiktok\.com",
    "pinterests": r"pinterest\.", "discords": r"discord(?:app)?\.", "snapchats": r"snapchat\.com", "threads": r"threads\.(?:com|net)", "telegrams": r"t\.me|telegram\.", "reddits": r"reddit\.com",
    "whatsapps": r"wa\.me|whatsapp\.com", "githubs": r"github\.com", "blueskys": r"bsky\.app", "mediums": r"medium\.com", "calendlys": r"calendly\.com",
}

#: First path segments that name no profile, by platform.
DROPPED_PATHS = {
    "twitters": TWITTER_RESERVED.split() + "about ar de download en es fr id it ja javascripts jobs ko nl personalization pl pt ru statuses sv tr".split(),
    "instagrams": "_n _u accounts direct explore p reel reels tv".split(),
    "facebooks": "business dialog events gaming groups hashtag help login marketplace permalink.php photo.php plugins policies settings share.php story.php watch".split(),
    "pinterests": "business categories discover ideas login pin search settings signup source today".split(),
    "discords": "api app channels developers download login register widget".split(),
    "threads": _THREADS_RESERVED.split(),
    "telegrams": "addemoji addstickers bg confirmphone iv login proxy setlanguage share socks".split(),
    "reddits": "comments message search submit wiki".split(),
    "githubs": GITHUB_RESERVED.split(),
    "calendlys": CALENDLY_RESERVED.split(),
}

# links

_TRACKERS = "_ga dclid fbclid feature gclid igsh igshid mc_cid mc_eid msclkid ref ref_src ref_url si source yclid".split()
TRACKING_PARAM = "^(?:utm_.*|" + "|".join(_TRACKERS) + ")$"
_SKIPPED = "avi css eot gif gz ico jpe?g js json mjs mp3 mp4 pdf png svg ttf webm webp woff2? xml zip".split()
SKIP_FILE = r"\.(?:" + "|".join(_SKIPPED) + r")(?:\?|$)"
_NOISE = r"account cart category checkout login page/\d+ register search signin tag wp-admin wp-json \d{4}/\d{2}".split()
NOISE_PATH = "/(?:" + "|".join(_NOISE) + ")(?:/|$)"
SEGMENT_TAIL = r"\.(?:aspx?|cfm|cgi|jsp|php\d?|s?html?)$"
KEYWORDS = (
    (100, r"^(?:contact(?:-?(?:details|form|info|sales|us))?|contactos?|get-in-touch|kontakt(?:-aufnehmen|formular)?|reach-us)$"),
    (90, "^(?:imprint|impressum|legal-notice|mentions-legales)$"),
    (80, "^(?:about(?:-?us)?|ber-uns|company|meet-the-team|our-team|people|team|ueber-uns|uber-uns|who-we-are)$"),
    (60, "^(?:customer-service|help(?:-center)?|locations?|offices?|stores?|support)$"),
    (40, "^(?:legal|privacy(?:-policy)?|terms(?:-of-(?:service|use))?)$"),
)
NO_KEYWORD = 10
NON_PAGE = ("#", "callto:", "data:", "javascript:", "mailto:", "phone:", "tel:", "telephone:")
CRAWL = {"pages": 20, "depth": 2, "early_exit": 8, "attempts": 40, "failures": 5, "good_remaining": 60}

# pages

SILENT_TAGS = frozenset("canvas iframe noscript script style svg template".split())
BLOCK_TAGS = frozenset("address article aside blockquote dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table td th tr ul".split())
BLOCKED_STATUS = (403, 429, 503)
CHALLENGES = ("<title>Just a moment...", "Please verify you are a human", "_Incapsula_")
APP_SHELLS = tuple(f"id={q}{name}{q}" for name in ("__next", "app", "root") for q in "\"'") + ("data-reactroot", "ng-app")
NEEDS_SCRIPT = r"enable\s+javascript|javascript\s+is\s+(?:disabled|required)|you need to enable javascript"
