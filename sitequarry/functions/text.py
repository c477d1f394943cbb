"""Text functions as column expressions: whitespace, contacts, dates, formatting, hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import let

SPACE = "[ \\t\\n\\x0B\\f\\r\\u00A0]"

# The patterns of contacts and dates.
PHONE = r"(?:\+39[\s.-]?)?(?:0\d{1,4}[\s.-]?\d{5,8}|3\d{2}[\s.-]?\d{6,7}|800[\s.-]?\d{5,6})"
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
ADDRESS = r"(?i)(?:Via|Piazza|Corso|Viale|Strada|Largo|Vicolo)\s+[A-Za-zÀ-ú']+(?:\s[A-Za-zÀ-ú']+){0,6}\s*,?\s*\d+[a-zA-Z]?,?\s*\d{5}"
DAYS = "luned[iì]|marted[iì]|mercoled[iì]|gioved[iì]|venerd[iì]|sabato|domenica"
HOURS = (
    rf"(?i)(?:{DAYS})[^.\n]{{0,150}}?\d{{1,2}}[:.]\d{{2}}\s*-\s*\d{{1,2}}[:.]\d{{2}}",
    rf"(?i)(?:{DAYS})[^.\n]{{0,80}}?dalle\s+(?:ore\s+)?\d{{1,2}}[:.]\d{{2}}\s+alle\s+(?:ore\s+)?\d{{1,2}}[:.]\d{{2}}",
    rf"(?i)(?:{DAYS})[^.\n]{{0,150}}?\d{{1,2}}[:.]\d{{2}}\s*[–—]\s*\d{{1,2}}[:.]\d{{2}}",
)
DATE_LABEL = r"(?i)(?:ultimo\s+aggiornamento|ultima\s+modifica|aggiornat[oa]\s+il|data\s+(?:di\s+)?(?:ultimo\s+aggiornamento|ultima\s+modifica))[^0-9a-zA-Zàèéìòù]{0,15}(\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}|\d{1,2}\s+[a-zàèéìòù]{3,9}\s+\d{4})"
# Fixed values of formatted messages: labels, the map's address, attributes and class names.
ADDRESS_LABELS, PHONE_LABELS = r"Indirizzo|Sede|Ubicazione", r"Telefono|Tel\.?|Cellulare|Cell\.?|Fax"
MAPS, OUTSIDE, ENTITY = "https://www.google.com/maps/search/?api=1&query=", ' target="_blank" rel="noopener noreferrer"', "chatbot__entity"
MONTHS = ("gennaio", "febbraio", "marzo", "aprile", "maggio", "giugno", "luglio", "agosto", "settembre", "ottobre", "novembre", "dicembre")


def squeezed(text: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.regexp_replace(F.regexp_replace(text, f"{SPACE}+", " "), "^ | $", "")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def normalize_text(text: Column) -> Column:
    """HTM5: no CR, no-break space as space, runs of spaces and tabs as one, three or more newlines as two, trimmed."""
    text = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r"), F.lit("")), F.lit("\u00a0"), F.lit(" "))
    return trimmed(F.regexp_replace(F.regexp_replace(text, "[ \t]+", " "), "\n{3,}", "\n\n"))


def paragraphs(text: Column) -> Column:
    """CHK1."""
    pieces = F.split(normalize_text(text), f"\n{SPACE}*\n")
    return F.filter(F.transform(pieces, trimmed), lambda p: p != "")


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({pattern})" if not pattern.startswith("(?i)") else f"(?i)({pattern[4:]})"), F.lit(1))


def phones(text: Column) -> Column:
    """HTM17: nine digits or more, different ones, ten at most."""
    bare = F.transform(found(text, PHONE), lambda p: F.regexp_replace(p, r"\s+", ""))
    return F.slice(F.array_distinct(F.filter(bare, lambda p: F.length(F.regexp_replace(p, "[^0-9]", "")) >= 9)), 1, 10)


def emails(text: Column) -> Column:
    """HTM18."""
    return F.slice(F.array_distinct(found(text, EMAIL)), 1, 10)


def addresses(text: Column) -> Column:
    """HTM19: bounded quantifiers, so long prose can't make it backtrack."""
    return F.slice(F.array_distinct(F.transform(found(text, ADDRESS), trimmed)), 1, 5)


def opening_hours(text: Column) -> Column:
    """HTM20: three notations, one after the other."""
    return F.slice(F.array_distinct(F.transform(F.concat(*[found(text, p) for p in HOURS]), squeezed)), 1, 5)


def strip_tags(html: Column) -> Column:
    """HTM22."""
    return squeezed(F.regexp_replace(html, "<[^>]*>", " "))


def visible_length(html: Column) -> Column:
    """HTM23: characters of the body without script, style and noscript."""
    body = F.coalesce(F.nullif(F.regexp_extract(html, r"(?is)<body[^>]*>(.*?)(?:</body>|\z)", 1), F.lit("")), html)
    return F.length(strip_tags(F.regexp_replace(body, r"(?is)<(script|style|noscript)\b.*?(</\1\s*>|\z)", " ")))


def needs_rendering(html: Column, least: int = 200) -> Column:
    return visible_length(html) < least


def visible_date(text: Column) -> Column:
    """HTM24 and HTM25: the date after a label of last change, as a date; a day that the month lacks rolls over."""
    return italian_date(F.nullif(F.regexp_extract(squeezed(text), DATE_LABEL, 1), F.lit("")))


def italian_date(raw: Column) -> Column:
    """HTM25: d/m/y or `d month yyyy`; null if it's neither. 31/02 rolls over into March, as dates of the source do."""
    numeric, worded = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{2,4})$", r"^(\d{1,2})\s+([a-zàèéìòù]{3,9})\s+(\d{4})$"

    def pieces(t: Column) -> Column:
        number = lambda p, g: F.regexp_extract(t, p, g).try_cast("int")
        return F.struct(number(numeric, 1).alias("d"), number(numeric, 2).alias("m"), number(numeric, 3).alias("y"), number(worded, 1).alias("wd"), F.regexp_extract(t, worded, 2).alias("name"), number(worded, 3).alias("wy"))

    def dated(p: Column) -> Column:
        rolled = lambda y, m, d: F.date_add(F.make_date(y, m, F.lit(1)), d - 1)
        names = {x: i + 1 for i, m in enumerate(MONTHS) for x in (m, m[:3])}
        month = F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), p["name"])
        year = F.when(p["y"] < 100, p["y"] + 2000).otherwise(p["y"])
        return F.when(p["d"].isNotNull(), F.when(p["m"].between(1, 12) & p["d"].between(1, 31), rolled(year, p["m"], p["d"]))).when(p["wd"].isNotNull() & month.isNotNull(), rolled(p["wy"], month, p["wd"]))

    return let(let(F.lower(trimmed(raw)), pieces), dated)


def strip_skip_links(markdown: Column) -> Column:
    """HTM28."""
    out = F.regexp_replace(markdown, r"(?i)\[(?:Vai al contenuto|Vai alla navigazione|Vai al footer|Salta al contenuto)\]\([^)]*\)", "")
    return trimmed(F.regexp_replace(out, "\n{3,}", "\n\n"))


def content_hash(text: Column) -> Column:
    """HTM29 and FUN1."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def cut(text: Column, n: int, mark: str = "...") -> Column:
    """FUN2."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def safe_links(text: Column) -> Column:
    """FUN3: markdown links that aren't http(s) become their text."""
    return F.regexp_replace(text, r"\[([^\]]+)\]\((?!https?://)[^)]*\)", "$1")


def url_component(text: Column) -> Column:
    """A text as a part of a URL: percent codes in UTF-8; letters, digits and - _ . ! ~ * ' ( ) stay."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for code, char in (("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(code), F.lit(char))
    return out


# What stands out in a line of a message, in one pattern: Markdown links, addresses, e-mail addresses, bold.
NAMED_LINK, BARE_URL, BOLD = r"\[[^\]]+\]\((?:https?://|mailto:|tel:)[^\s)]+\)", r"https?://[^\s<>\"']+", r"\*\*[^*]+\*\*"


def labelled(words: str, value: str) -> str:
    """A line that begins with a label, maybe as a list item or bold: what leads to the value, the value, the rest."""
    return rf"(?i)^([ \t]*(?:[•-]\s*)?\*{{0,2}}(?:{words})\*{{0,2}}\s*:\s*\*{{0,2}}){value}(.*)$"


def element(href: Column, shown: Column, attributes: str) -> Column:
    return F.concat(F.lit('<a href="'), href, F.lit(f'"{attributes}>'), shown, F.lit("</a>"))


def spans(text: Column, bold: bool = True) -> Column:
    """A stretch of a line, cut at what stands out in it; each piece becomes HTML by its kind, what is between stays."""
    pattern = "|".join([NAMED_LINK, BARE_URL, EMAIL, *[BOLD] * bold])
    mail = lambda x: element(F.concat(F.lit("mailto:"), x), x, f' class="{ENTITY} {ENTITY}--email" title="Invia email"')

    def piece(x: Column) -> Column:
        name, target = F.regexp_extract(x, r"^\[([^\]]+)\]", 1), F.regexp_extract(x, r"\(([^\s)]+)\)$", 1)
        own = F.when(name.rlike(f"^(?:{EMAIL})$"), mail(name)).otherwise(name)
        by_kind = F.when(x.startswith("["), F.when(target.startswith("http"), element(target, target, OUTSIDE)).otherwise(own)).when(x.rlike("^https?://"), element(x, x, OUTSIDE))
        if bold:
            by_kind = by_kind.when(x.startswith("**"), F.concat(F.lit("<strong>"), spans(F.regexp_replace(x, r"^\*\*|\*\*$", ""), bold=False), F.lit("</strong>")))
        return by_kind.otherwise(mail(x))

    pieces = F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), piece)
    return F.when(text.rlike(pattern), F.array_join(F.zip_with(F.split(text, pattern), pieces, lambda a, p: F.concat(a, F.coalesce(p, F.lit("")))), "")).otherwise(text)


def message_html(text: Column) -> Column:
    """FUN4: a message as HTML, a line at a time: a heading is bold, an address or a phone after its label a link to the map or the phone, and in
    all else links, e-mail addresses and bold are found in one scan (a Markdown link shows its address). A label and what it labels stand on one line."""
    address = labelled(ADDRESS_LABELS, rf"((?!\s*(?:{NAMED_LINK}|https?://|$))(?:(?!{NAMED_LINK}|https?://)[^<])+)")
    phone = labelled(PHONE_LABELS, r"([+\d][\d\s./-]{5,}\d)")

    def with_value(line: Column, pattern: str, link) -> Column:
        lead, value, rest = (F.regexp_extract(line, pattern, i) for i in (1, 2, 3))
        return F.concat(spans(lead), link(trimmed(value)), spans(rest))

    def formatted(line: Column) -> Column:
        on_map = lambda a: element(F.concat(F.lit(MAPS), url_component(a)), a, f'{OUTSIDE} class="{ENTITY} {ENTITY}--address" title="Apri su Google Maps"')
        to_call = lambda n: element(F.concat(F.lit("tel:"), F.regexp_replace(n, r"[^\d+]", "")), n, f' class="{ENTITY} {ENTITY}--phone" title="Chiama"')
        heading = F.concat(F.lit("<strong>"), spans(F.regexp_extract(line, r"^#{1,6}\s+(.+)$", 1)), F.lit("</strong>"))
        return F.when(line.rlike(r"^#{1,6}\s+."), heading).when(line.rlike(address), with_value(line, address, on_map)).when(line.rlike(phone), with_value(line, phone, to_call)).otherwise(spans(line))

    return F.array_join(F.transform(F.split(text, "\n"), formatted), "<br>")


def labelled_lines(*lines: tuple[str, Column]) -> Column:
    """FUN5: `label: value` lines; those without a value are left out."""
    return F.concat_ws("\n", *[F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(label), v)) for label, v in lines])


def overlaid(base: Column, over: Column) -> Column:
    """FUN6 and FUN11: two maps, of which the second wins; null values don't."""
    kept = F.map_filter(over, lambda k, v: v.isNotNull())
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(kept, k)), kept)


def backoff_ms(attempts: Column, base: int = 1000, most: int = 30 * 60 * 1000) -> Column:
    """FUN7: doubling delays, without jitter so that runs agree."""
    return F.least(F.lit(most), (base * F.pow(F.lit(2.0), attempts)).cast("double")).cast("long")


def is_final(retryable: Column, attempts: Column, most: int = 6) -> Column:
    return ~retryable | (attempts + 1 >= most)


def age_seconds(at: Column, now: Column) -> Column:
    """FUN8."""
    return F.unix_timestamp(now) - F.unix_timestamp(at)


def is_stale(status: Column, heartbeat: Column, now: Column, seconds: int = 20) -> Column:
    return (status == "running") & (F.coalesce(age_seconds(heartbeat, now), F.lit(seconds + 1)) > seconds)


def yyyymmdd(at: Column) -> Column:
    """FUN9."""
    return F.date_format(at, "yyyyMMdd")


def parsed_json(text: Column, schema: str, default: Column) -> Column:
    """FUN10: a default where the text isn't of the schema."""
    return F.coalesce(F.from_json(text, schema), default)


def clamped_number(text: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """FUN12: the first decimal in a text, clamped; null if there is none."""
    n = F.nullif(F.regexp_extract(text, r"(-?\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double")
    return F.when(n.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), n)))
