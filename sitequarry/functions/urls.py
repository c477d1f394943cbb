"""URL functions as column expressions: canonical forms, hosts, path classes. IDs are those of SURVEY section 2.2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What canonical URLs leave out, and which paths are of a class.
TRACKING_PARAMS = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid", "mc_cid", "mc_eid", "ref", "igshid")
SKIPPED_SCHEMES = ("mailto", "tel", "javascript", "sms", "whatsapp", "data", "ftp")
BINARY_EXTENSIONS = tuple("pdf doc docx xls xlsx ppt pptx zip rar 7z gz tar dmg exe jpg jpeg png gif svg webp ico bmp mp3 mp4 avi mov wav ogg webm css js mjs woff woff2 ttf eot json xml".split())
ASSET_EXTENSIONS = tuple("jpg jpeg png gif pdf docx xlsx zip ico css js woff woff2 ttf svg mp4 mp3 webp".split())
NEWS_SEGMENTS = "novita|notizie|news|comunicat[oi]|comunicati-stampa|avvisi|press|press-release|blog|articoli|article"
FILE_SEGMENTS = "media|file|files|document[oi]?|documenti|allegat[oi]|attachment[si]?|download[s]?|asset[s]?|risorsa|risorse"
UTILITY_SEGMENTS = "accedi|login|log-in|signin|sign-in|logout|log-out|esci|cerca|ricerca|search|cart|carrello|account|registrati|register|iscriviti"
NOISE_ATTRIBUTES = "target|rel|onclick|class|id|style|title|data-[^=\\s]+"
CITY_HOSTS = ("comune\\.([^.]+)\\.it", "([^.]+)\\.gov\\.it", "([^.]+)\\.comune\\.it")

URL = r"^(?i)(https?)://(?:[^/?#]*@)?([^/?#:@\[\]\s]+|\[[0-9a-f:.]+\])(?::([0-9]*))?(/[^?#]*)?(?:\?([^#]*))?(?:#.*)?$"
# The URL standard's parser, as patterns: what surrounds a URL, its parts (slashes may lean either way), the host and port, segments that mean a step.
AROUND = "[\\x00-\\x20\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]+"
ABSOLUTE = r"(?is)^(https?):[/\\]*([^/\\?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"
HOST = r"(?i)^(\[[0-9a-f:.]+\]|[^\x00-\x20\x7F#/<>?@\\\[\]^|%:]+)(?::([0-9]*))?$"
SCHEME = "(?i)^[a-z][a-z0-9+.-]*:"
HERE, UP = "(?i)^(\\.|%2e)$", "(?i)^(\\.|%2e){2}$"
STEPS = "(?i)[/\\\\](\\.|%2e){1,2}([/\\\\]|$)"
# Characters that are percent-encoded in a path and in a query.
PATH_CODED = "[\\x00-\\x20\"#<>?^`{}\\x7F-\\x{10FFFF}]"
QUERY_CODED = "[\\x00-\\x20\"#'<>\\x7F-\\x{10FFFF}]"
DEFAULT_PORTS = {"http": "80", "https": "443"}
NEWS = f"(?i)(^|/)({NEWS_SEGMENTS})(/|$)"
NON_PAGE = f"(?i)(^|/)({FILE_SEGMENTS})/[0-9]+(/|$)"
ASSET = rf"(?i)\.({'|'.join(ASSET_EXTENSIONS)})(\?.*)?$"
UTILITY = rf"(?i)/({UTILITY_SEGMENTS})(/|\?|#|$)"


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def parts_of(url: Column) -> Column:
    """All parts of an http(s) URL in one match: [scheme, host, port, path, query], null if it isn't one."""
    return F.when(F.trim(url).rlike(URL), F.split(F.regexp_replace(F.trim(url), URL, "$1\x01$2\x01$3\x01$4\x01$5"), "\x01"))


def part(url: Column, group: int) -> Column:
    """A part of an http(s) URL: 1 scheme, 2 host, 3 port, 4 path, 5 query; null if the URL isn't one, '' if it lacks the part."""
    return F.when(F.trim(url).rlike(URL), F.regexp_extract(F.trim(url), URL, group))


def percent_coded(text: Column, which: str) -> Column:
    """text with the characters of a class percent-encoded as UTF-8."""
    coded = F.transform(F.split(text, ""), lambda c: F.when(c.rlike(which), F.when(c == " ", "%20").otherwise(F.url_encode(c))).otherwise(c))
    return F.when(text.rlike(which), F.array_join(coded, "")).otherwise(text)


def folded_path(path: Column) -> Column:
    """A path without steps: a stack of its segments, on which `.` leaves all as it is and `..` takes the last one off. A step at the end leaves a slash there."""
    down = lambda stack, s: F.when(s.rlike(UP), F.slice(stack, 1, F.greatest(F.size(stack) - 1, F.lit(0)))).when(s.rlike(HERE), stack).otherwise(F.concat(stack, F.array(s)))
    stack = lambda segments: F.aggregate(segments, F.array().cast("array<string>"), down)
    last = lambda segments: F.when(F.element_at(segments, -1).rlike("(?i)^(\\.|%2e){1,2}$"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    segments = F.split(F.regexp_replace(path, r"^[/\\]", ""), r"[/\\]")
    folded = let(segments, lambda x: F.concat(F.lit("/"), F.array_join(F.concat(stack(x), last(x)), "/")))
    slashed = F.when(path == "", "/").otherwise(F.translate(path, "\\", "/"))
    return F.when(path.rlike(STEPS), folded).otherwise(slashed)


def parsed(url: Column, coded: bool = True) -> Column:
    """The parts of an absolute http(s) URL as the URL standard has them: scheme, user, host, port (without the default one), path, query; null if it isn't one. coded=False: path and query keep the
    characters that they are written with."""
    code = percent_coded if coded else lambda text, which: text

    def parts(x: Column) -> Column:
        p, at = x["p"], F.regexp_extract(x["p"][1], "^(.*)@", 1)
        scheme, place = F.lower(p[0]), F.lower(F.regexp_replace(p[1], "^.*@", ""))
        place = F.when(place.contains("%"), F.lower(F.try_url_decode(F.replace(place, F.lit("+"), F.lit("%2B"))))).otherwise(place)
        port = F.regexp_replace(F.regexp_extract(place, HOST, 2), "^0+(?=[0-9])", "")
        default = F.create_map(*[F.lit(v) for kv in DEFAULT_PORTS.items() for v in kv])
        shown = F.when((port == "") | (port == F.element_at(default, scheme)), "").otherwise(port)
        fits = place.rlike(HOST) & (F.length(port) < 6) & F.coalesce(port.try_cast("int") < 65536, port == "")
        return F.when(fits, F.struct(
            scheme.alias("scheme"), F.replace(F.regexp_replace(at, ":$", ""), F.lit("@"), F.lit("%40")).alias("user"), F.regexp_extract(place, HOST, 1).alias("host"), shown.alias("port"),
            code(folded_path(p[2]), PATH_CODED).alias("path"), code(p[3], QUERY_CODED).alias("query"),
        ))

    bare = F.regexp_replace(F.regexp_replace(url, f"^{AROUND}|{AROUND}$", ""), "[\t\n\r]", "")
    held = F.replace(bare, F.lit("\x01"), F.lit("%01"))
    matched = F.when(held.rlike(ABSOLUTE), F.split(F.regexp_replace(held, ABSOLUTE, "$1\x01$2\x01$3\x01$4"), "\x01"))
    return let(F.struct(matched.alias("p")), lambda x: F.when(x["p"].isNotNull(), parts(x)))


def origin(p: Column) -> Column:
    return F.concat(p["scheme"], F.lit("://"), F.when(p["user"] != "", F.concat(p["user"], F.lit("@"))).otherwise(""), p["host"], F.when(p["port"] != "", F.concat(F.lit(":"), p["port"])).otherwise(""))


def resolve(href: Column, base: Column, parts: Column | None = None) -> Column:
    """An href against the page it stands on, absolute but not yet parsed; null if it has another scheme than http(s). parts: parsed(base), if it is at hand for many hrefs."""

    def against(b: Column) -> Column:
        h, p = b["h"], b["p"]
        same = F.coalesce(F.lower(F.substring_index(h, ":", 1)) == p["scheme"], F.lit(False))
        stands = p.isNotNull() | base.rlike("(?i)^(?!https?:)[a-z][a-z0-9+.-]*:")  # a page of another scheme has no relative hrefs
        short = same & ~h.rlike(r"^[^:]*:[/\\]{2}")  # the page's own scheme before a relative href
        rest = F.when(h.rlike(SCHEME) & short, F.regexp_replace(h, SCHEME, "")).otherwise(h)
        query = F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise("")
        return (
            F.when(h.rlike(SCHEME) & ~short, F.when(stands & h.rlike("(?i)^https?:"), h))
            .when(rest.rlike(r"^[/\\]{2}"), F.concat(p["scheme"], F.lit(":"), rest))
            .when(rest.rlike(r"^[/\\]"), F.concat(origin(p), rest))
            .when(rest.startswith("?"), F.concat(origin(p), p["path"], rest))
            .when((rest == "") | rest.startswith("#"), F.concat(origin(p), p["path"], query))
            .otherwise(F.concat(origin(p), F.regexp_replace(p["path"], "[^/]*$", ""), rest))
        )

    bare = F.regexp_replace(F.regexp_replace(href, f"^{AROUND}|{AROUND}$", ""), "[\t\n\r]", "")
    return let(F.struct(bare.alias("h"), (parsed(base) if parts is None else parts).alias("p")), against)


def form_decoded(text: Column) -> Column:
    """A part of a query as form data: + is a space, percent codes are UTF-8, and what is no code stays."""
    return F.when(text.rlike("[%+]"), F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))).otherwise(text)


def form_coded(text: Column) -> Column:
    return F.when(text.rlike("[^A-Za-z0-9*._-]"), F.url_encode(text)).otherwise(text)


def normalize_url(raw: Column, base: Column | None = None, parts: Column | None = None, coded: bool = True) -> Column:
    """URL1: the canonical form, null for what can't be a page. parts: parsed(base), if it is at hand. coded=False: a path keeps the characters that it is written with."""

    def canonical(u: Column) -> Column:
        p = u["p"]
        pair = lambda x, i: F.struct(form_decoded(F.substring_index(x, "=", 1)).alias("k"), i.alias("i"), form_decoded(F.when(x.contains("="), F.regexp_replace(x, "^[^=]*=", "")).otherwise("")).alias("v"))
        pairs = F.filter(F.transform(F.filter(F.split(p["query"], "&"), lambda x: x != ""), pair), lambda x: ~F.lower(x["k"]).isin(*TRACKING_PARAMS))
        query = F.array_join(F.transform(F.array_sort(pairs), lambda x: F.concat(form_coded(x["k"]), F.lit("="), form_coded(x["v"]))), "&")
        shown = F.when(p["query"] == "", "").otherwise(let(query, lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q))))
        binary = F.lower(p["path"]).rlike(rf"\.({'|'.join(BINARY_EXTENSIONS)})$")
        cut = F.when((F.length(p["path"]) > 1) & p["path"].endswith("/"), F.regexp_replace(p["path"], "/$", "")).otherwise(p["path"])
        return F.when(p.isNotNull() & ~binary, F.concat(origin(p), cut, shown))

    if base is not None and parts is None and not coded:
        parts = parsed(base, coded)
    return let(F.struct(parsed(raw if base is None else resolve(raw, base, parts), coded).alias("p")), canonical)


def host_of(url: Column) -> Column:
    """URL2."""
    return F.lower(part(url, 2))


def registrable_host(host: Column) -> Column:
    """URL3: one leading www. off."""
    return F.regexp_replace(host, r"^www\.", "")


def site_of(url: Column) -> Column:
    """URL13, and the join key of same_site."""
    return registrable_host(host_of(url))


def same_site(a: Column, b: Column) -> Column:
    """URL4, of two hosts."""
    return registrable_host(a) == registrable_host(b)


def is_news_like(url: Column) -> Column:
    """URL5."""
    return F.coalesce(part(url, 4).rlike(NEWS), F.lit(False))


def is_likely_non_page(url: Column) -> Column:
    """URL6."""
    return F.coalesce(part(url, 4).rlike(NON_PAGE), F.lit(False))


def is_binary(url: Column) -> Column:
    """URL7."""
    return F.coalesce(url.rlike(ASSET), F.lit(False))


def is_utility(url: Column) -> Column:
    """URL8: whole segments, so /ricercatori is none."""
    return F.coalesce(url.rlike(UTILITY), F.lit(False))


def light_normalize(href: Column, base: Column | None = None) -> Column:
    """URL9: no fragment, no last slash (the root's neither), parameters as they are."""

    def plain(u: Column) -> Column:
        p = u["p"]
        return F.regexp_replace(F.concat(origin(p), p["path"], F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise("")), "/$", "")

    url = F.trim(href) if base is None else resolve(href, base)
    return F.when(~F.trim(href).rlike("^(?i)(#|javascript:|mailto:|tel:)"), let(F.struct(parsed(url).alias("p")), plain))


def clean_href(href: Column, base: Column | None = None) -> Column:
    """URL10: attributes that ran into the href taken out, then URL9."""
    return light_normalize(F.trim(F.regexp_replace(href, rf"(?i)\s*\b({NOISE_ATTRIBUTES})\s*=\s*[\"'][^\"']*[\"']\s*", " ")), base)


def slug(url: Column) -> Column:
    """URL11."""
    return F.regexp_replace(F.lower(F.coalesce(part(url, 4), F.lit(""))), "[/_-]+", " ")


def city_code(url: Column) -> Column:
    """URL12: of the first pattern that the host matches."""
    return F.upper(F.coalesce(*[F.nullif(F.regexp_extract(host_of(url), p, 1), F.lit("")) for p in CITY_HOSTS]))


def is_valid_url(url: Column) -> Column:
    """URL14: an absolute URL of any scheme."""
    return F.coalesce(F.trim(url).rlike(r"^(?i)([a-z][a-z0-9+.-]*://[^/?#\s]+|(mailto|tel|data|javascript|sms):)\S*"), F.lit(False))


def urls_equal(a: Column, b: Column) -> Column:
    """URL15: two arrays, in order; false if one is null."""
    return F.coalesce(a == b, F.lit(False))


def urls_in(text: Column) -> Column:
    """URL16: the different URLs in a text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(https?://[^\s]+)"), F.lit(1)))
