"""Scores and classes as column expressions. IDs are those of SURVEY section 2.6, and FLT12-FLT18."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .urls import is_likely_non_page, is_news_like, let, slug

# Words and weights of the scores.
TOKEN_BREAK = "[^a-zA-Z0-9_ \\t\\n\\r\\x0B\\fàèéìíîòóùú]"
CONTACT_WORDS = ("telefono", "email", "indirizzo", "orari", "orario")
SERVICE_WORDS = ("servizio", "prenotazione", "appuntamento", "documenti")
DETAIL_WORDS = ("costo", "prezzo", "validità", "scadenza", "requisiti")
SUPPORT_PAGES = ("contatt", "orari", "orario", "chi siamo", "chi-siamo", "dove siamo", "dove-siamo")
BOOKING = "(?i)(prenot|visita|cup|appuntament)"
LICENCE = "(^|[^a-z0-9_])(patente|patenti|commissione medica locale|motorino|rinnovo patente|cml)([^a-z0-9_]|$)"
NAV_MARKERS = ("mappa del sito", "lavora con noi", "note legali", "cookie policy", "privacy policy", "accessibilità")
FOOTER_MARKERS = ("ufficio stampa", "dicono di noi", "comunicati stampa", "materiale e documenti", "fatturazione elettronica", "servizi di supporto tecnico", "posta elettronica certificata")
TITLE_LIKE = r"^[A-Z0-9À-ÿ]\p{L}*(\s[A-Z0-9À-ÿ]\p{L}*){0,4}$"
SERVICE_TERMS = ("servizio", "servizi", "ufficio", "sportello", "procedura", "certificato", "certificati", "anagrafe", "stato civile")
FORM_TERMS = ("modulo", "moduli", "domanda", "istanza", "richiesta", "form", "modello", "pratica", "documenti", "documentazione")
CONTACT_TERMS = ("telefono", "email", "indirizzo", "contatto", "contatti", "orari", "apertura", "chiusura", "ufficio")
LANGUAGE_WORDS = {
    "it": "il|lo|la|di|da|in|con|per|tra|frra|gli|sono|essere|avere|fare|volevo|possso|come|cosa|dove|quando|perché|grazie|buongiorno|buonasera|prego|scusi|perdoni|chiedere|rispondere|comunicare|informare|richiedere|ottenere|documento|certificato|ufficio|anagrafe|tributi|imposta|tassa|servizio|appuntamento|prenotazione|versamento|bollette|bolletta|pagamento|scadenza|comune|cittadino",
    "de": "der|die|das|ein|eine|und|oder|aber|nicht|sein|haben|werden|können|müssen|sollen|wollen|bitte|danke|guten|morgen|abend|herr|frau|ich|du|wir|sie|es|hat|ist|war|werden",
    "fr": "le|la|les|un|une|du|des|et|ou|mais|ne|pas|être|avoir|pouvoir|vouloir|doit|falloir|savoir|merci|bonjour|bonsoir|madame|monsieur|je|tu|nous|vous|ils|elle|est|sont|était|été",
    "en": "the|is|are|you|your|what|how|can|could|would|please|hello|hi|thanks|thank|information|need|want|payment|bill|bills|help|when|where|which|who|does|do|did|have|has|will|about|invoice|document|office|certificate|appointment|schedule|request|tax|and|for|with",
}
DOCUMENT_PHRASES = ("analizza documento", "leggi documento", "documento", "referto", "certificato", "prescrizione", "cartella", "esame", "analisi", "valori", "analizza foto", "leggi foto", "foto documento", "foto referto")
VOICE_COMMANDS = {
    "stop ascolto": "stop_listening", "ferma microfono": "stop_listening", "inizia ascolto": "start_listening", "attiva microfono": "start_listening",
    "aiuto": "show_help", "help": "show_help", "ripeti": "repeat_last", "cancella": "clear_chat", "reset": "reset_session",
}
MIME_KINDS = {
    "image/jpeg": "image", "image/png": "image", "image/webp": "image", "image/gif": "image", "application/pdf": "document", "application/msword": "document",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "document", "text/plain": "document",
}
DIRECTIONS = r"(?i)(^|[^A-Za-z0-9_])(raggiung|arriv|indicazioni|percorso([^A-Za-z0-9_]|$))|dove\s+si\s+trova"
PLACE = r"(?i)(?:raggiung\w*|arriv\w*|vad[oa]|vai)\s+(?:a|al|allo|alla|ai|agli|alle|presso|in|il|lo|la)?\s*([^?.\n]+)"
ADDRESS_LINE = r"(?im)^[ \t]*(?:[•-]\s*)?\*{0,2}(?:Indirizzo|Sede|Ubicazione)\*{0,2}\s*:\s*\*{0,2}(?!https?://)([^\n<]+)"
INJECTIONS = (
    r"ignora\s+(tutte\s+le\s+)?istruzioni\s+(precedenti|di\s+sistema)",
    r"disattiva\s+(le\s+)?(tue\s+)?(regole|restrizioni|limitazioni)",
    r"(rivelami|mostrami|stampa)\s+.{0,20}(system\s?prompt|prompt\s+di\s+sistema|istruzioni\s+di\s+sistema)",
    r"you\s+are\s+now\s+(in\s+)?(dan|jailbreak|developer\s+mode)",
    r"ignore\s+(all\s+)?(previous|prior|above)\s+instructions",
    r"reveal\s+(your\s+)?(system\s+prompt|instructions)",
)
INSIGHTS = {
    "news": r"news|aggiornamento|nuovo|da oggi|ultim[a]? ora|ultima ora|breaking",
    "warning": r"manutenzione|offline|attenzione|avviso|interruzione|problema|urgente",
    "offer": r"sconto|offerta|promozione|speciale|da non perdere|promo",
}
PRIORITY = {"seed": 1000, "sitemap": 100, "link": 0, "recrawl": 1000}
NEWS_PENALTY, NON_PAGE_PENALTY = 500, 2000


def words_in(words: str) -> str:
    """A pattern for whole words, in the sense of ASCII word characters."""
    return f"(?i)(^|[^A-Za-z0-9_])({words})([^A-Za-z0-9_]|$)"


def any_of(text: Column, terms: tuple[str, ...]) -> Column:
    return F.greatest(*[text.contains(t) for t in terms]) if len(terms) > 1 else text.contains(terms[0])


def frontier_priority(kind: Column, url: Column) -> Column:
    """SCO1: by origin, less for news, far less for files; seeds keep theirs."""
    base = F.coalesce(*[F.when(kind == k, v) for k, v in PRIORITY.items()], F.lit(0))
    lower = F.when(is_news_like(url), NEWS_PENALTY).otherwise(0) + F.when(is_likely_non_page(url), NON_PAGE_PENALTY).otherwise(0)
    return F.when(kind.isin("seed", "recrawl"), base).otherwise(base - lower)


def tokens(query: Column) -> Column:
    """SCO2: words of three characters and more."""
    return F.filter(F.split(F.regexp_replace(F.lower(query), TOKEN_BREAK, " "), f"{T.SPACE}+"), lambda t: F.length(t) > 2)


def query_analysis(query: Column) -> Column:
    """SCO3 as a struct."""
    t = tokens(query)
    has = lambda words: F.arrays_overlap(t, F.array(*map(F.lit, words)))
    contact, service, detail = (F.coalesce(has(w), F.lit(False)) for w in (CONTACT_WORDS, SERVICE_WORDS, DETAIL_WORDS))
    simple = F.length(query) < 50
    complexity = contact.cast("int") + service.cast("int") + detail.cast("int") + (~simple).cast("int")
    strategy = F.when(complexity <= 1, "targeted").when(complexity <= 2, "adaptive").otherwise("comprehensive")
    return F.struct(complexity.alias("complexity"), strategy.alias("strategy"), contact.alias("has_contact"), service.alias("has_service"), detail.alias("has_detail"), simple.alias("is_simple"), F.least(F.lit(15000), 5000 + complexity * 3000).alias("budget_ms"), t.alias("tokens"))


def occurrences(text: Column, token: Column) -> Column:
    """Non-overlapping ones."""
    return ((F.length(text) - F.length(F.replace(text, token, F.lit("")))) / F.length(token)).cast("int")


def page_relevance(query_tokens: Column, title: Column, description: Column, headings: Column, text: Column) -> Column:
    """SCO4."""
    title, heads = F.lower(F.coalesce(title, F.lit(""))), F.lower(F.coalesce(F.array_join(headings, " "), F.lit("")))
    whole = F.concat_ws(" ", title, F.lower(F.coalesce(description, F.lit(""))), heads, F.lower(F.coalesce(text, F.lit(""))))
    gain = lambda p: lambda n, t: n + occurrences(p["w"], t) + F.when(F.contains(p["t"], t), 5).otherwise(0) + F.when(F.contains(p["h"], t), 3).otherwise(0)
    return let(F.struct(title.alias("t"), heads.alias("h"), whole.alias("w")), lambda p: F.aggregate(query_tokens, F.lit(0), gain(p)))


def link_score(query_tokens: Column, anchor: Column, url: Column) -> Column:
    """SCO5."""
    gain = lambda p: lambda n, t: n + F.when(F.contains(p["a"], t), 4).otherwise(0) + F.when(F.contains(p["s"], t), 3).otherwise(0)
    score = lambda p: F.aggregate(query_tokens, F.lit(0), gain(p)) + F.when(any_of(p["a"], SUPPORT_PAGES) | any_of(p["s"], SUPPORT_PAGES), 5).otherwise(0)
    return F.when(F.size(query_tokens) > 0, let(F.struct(F.lower(F.coalesce(anchor, F.lit(""))).alias("a"), slug(url).alias("s")), score)).otherwise(0)


def child_bonus(parent_qualifies: Column) -> Column:
    """SCO6."""
    return F.when(parent_qualifies, 50).otherwise(0)


def closeness(distance: Column) -> Column:
    """SCO7."""
    return F.coalesce(1 / (1 + distance), F.lit(0.0))


def keyword_boost(query: Column, text: Column, title: Column) -> Column:
    """SCO8."""
    low = F.struct(F.lower(F.coalesce(text, F.lit(""))).alias("body"), F.lower(F.coalesce(title, F.lit(""))).alias("head"))
    return let(low, lambda p: boost_of(query, p["body"], p["head"], p["body"].rlike(LICENCE) | p["head"].rlike(LICENCE)))


def boost_of(query: Column, body: Column, head: Column, licence: Column) -> Column:
    """SCO8 from a chunk's lower-cased sides, and whether they are about licences."""
    p = {"body": body, "head": head}
    long_words = F.filter(F.split(F.lower(query), f"{T.SPACE}+"), lambda w: F.length(w) >= 3)
    gain = lambda n, w: n + F.when(F.contains(p["head"], w), 0.25).otherwise(0.0) + F.when(F.contains(p["body"], w), 0.10).otherwise(0.0)
    return F.aggregate(long_words, F.lit(0.0), gain) - F.when(query.rlike(BOOKING) & licence, 2.5).otherwise(0.0)


def navigation_penalty(text: Column) -> Column:
    """SCO9."""
    hits = lambda low, markers: sum((F.contains(low, F.lit(m)).cast("int") for m in markers), F.lit(0))
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), T.trimmed), lambda x: x != "")
    menu_like = lambda x: let(F.regexp_replace(x, r"^[-•·]\s*", ""), lambda bare: (F.length(bare) < 45) & bare.rlike(TITLE_LIKE))
    ratio = let(lines, lambda ls: F.when(F.size(ls) > 0, F.size(F.filter(ls, menu_like)) / F.size(ls)).otherwise(0.0))
    seen = let(F.lower(F.coalesce(text, F.lit(""))), lambda low: F.struct(hits(low, NAV_MARKERS).alias("nav"), hits(low, FOOTER_MARKERS).alias("foot")))

    def penalty(p: Column) -> Column:
        nav, foot, r = p["seen"]["nav"], p["seen"]["foot"], p["ratio"]
        first = F.when((nav >= 3) & (r > 0.5), 1.0).otherwise(0.0) + F.when((foot >= 4) & (r > 0.4), 0.8).otherwise(0.0)
        return first + F.when(r > 0.7, 1.0).when((r > 0.5) & (nav >= 2), 0.4).otherwise(0.0)

    return let(F.struct(seen.alias("seen"), ratio.alias("ratio")), penalty)


def rerank_score(query: Column, text: Column, title: Column, distance: Column) -> Column:
    """SCO10."""
    return closeness(distance) + keyword_boost(query, text, title) + length_bonus(text) - navigation_penalty(text)


def length_bonus(text: Column) -> Column:
    """SCO10's part for the length."""
    return F.least(F.length(F.coalesce(text, F.lit(""))) / 3000, F.lit(0.15))


def language(text: Column) -> Column:
    """SCO11: the first language of which a word occurs; null if none."""
    found = F.when(text.rlike("[؀-ۿ]"), "ar")
    for lang, words in LANGUAGE_WORDS.items():
        found = found.when(text.rlike(words_in(words)), lang)
    return found


def query_intent(query: Column) -> Column:
    """SCO12 as a struct."""
    q = F.lower(query)
    service, form, contact = (any_of(q, t) for t in (SERVICE_TERMS, FORM_TERMS, CONTACT_TERMS))
    priority = F.when(form, "high").when(contact | service, "medium").otherwise("low")
    keywords = F.slice(F.filter(F.split(q, f"{T.SPACE}+"), lambda w: F.length(w) > 3), 1, 5)
    return F.struct(service.alias("service"), form.alias("form"), contact.alias("contact"), (~(service | form | contact)).alias("general"), priority.alias("priority"), keywords.alias("keywords"))


def search_strategy(intent: Column, api: Column, scraper: Column, crawler: Column) -> Column:
    """SCO13."""
    return (
        F.when((intent["form"] | intent["contact"]) & scraper, "scraper_first")
        .when(intent["general"] & crawler, "crawler_first")
        .when((intent["priority"] == "high") & scraper & crawler, "parallel")
        .when(scraper | crawler | api, "scraper_first")
        .otherwise("fallback")
    )


def keyword_matches(query: Column, text: Column) -> Column:
    """SCO14."""
    return F.size(F.filter(F.split(F.lower(query), f"{T.SPACE}+"), lambda w: F.contains(F.lower(text), w)))


def low_confidence(citations: Column, confidence: Column, least: float = 0.3) -> Column:
    """SCO15."""
    return (F.coalesce(citations, F.lit(0)) == 0) | (F.coalesce(confidence, F.lit(0.0)) < least)


def ingestion_phase(status: Column, crawl_complete: Column, pending: Column, indexed: Column) -> Column:
    """SCO16."""
    count = lambda c: F.coalesce(c, F.lit(0))
    running = F.when(~F.coalesce(crawl_complete, F.lit(False)), "crawling").when(count(pending) > 0, "embedding").otherwise("indexing")
    return F.when(status.isNull(), "legacy").when(status.isin("queued", "paused"), "pending").when(status == "running", running).when(status == "completed", F.when(count(indexed) > 0, "ready").otherwise("empty")).otherwise("failed")


def first_phrase(text: Column, phrases: dict[str, str]) -> Column:
    """SCO17: what the first phrase stands for that occurs in a text; null if none does."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*[F.when(low.contains(phrase), meaning) for phrase, meaning in phrases.items()], F.lit(None))


def is_document_query(query: Column) -> Column:
    """SCO17: whether a question is about a document."""
    return any_of(F.lower(F.coalesce(query, F.lit(""))), DOCUMENT_PHRASES)


def voice_command(transcript: Column) -> Column:
    """SCO17: the action that a spoken phrase asks for."""
    return first_phrase(transcript, VOICE_COMMANDS)


def media_kind(mime: Column) -> Column:
    """SCO18: image, document, or null for a type that isn't known."""
    return F.coalesce(*[F.when(mime == m, kind) for m, kind in MIME_KINDS.items()], F.lit(None))


def direction_place(question: Column, answer: Column) -> Column:
    """SCO19: where someone asks the way to: the address line of the answer, else the place in the question; null where neither asks or tells the way."""
    question, answer = F.coalesce(question, F.lit("")), F.coalesce(answer, F.lit(""))
    address = F.regexp_replace(T.trimmed(F.regexp_extract(answer, ADDRESS_LINE, 1)), r"\.$", "")
    place = T.trimmed(F.regexp_extract(question, PLACE, 1))
    told = answer.rlike(ADDRESS_LINE)
    return F.when(question.rlike(DIRECTIONS) | answer.rlike(DIRECTIONS), F.when(told, address).when(question.rlike(PLACE), place))


def answer_badge(role: Column, citations: Column, low: Column) -> Column:
    """SCO20."""
    return F.when((role == "assistant") & (F.coalesce(citations, F.lit(0)) > 0), F.when(low, "indicative").otherwise("verified"))


def needs_rewrite(query: Column) -> Column:
    """FLT12."""
    return (F.length(query) >= 80) & (F.size(F.filter(F.split(query, f"{T.SPACE}+"), lambda w: w != "")) > 6)


def is_injection(text: Column) -> Column:
    """FLT13."""
    hit = F.lit(False)
    for p in INJECTIONS:
        hit = hit | F.coalesce(text.rlike(f"(?i){p}"), F.lit(False))
    return hit


def clamp(value: Column, low: float, high: float, fallback: float) -> Column:
    """FLT15: a number in range, or the fallback if it's none."""
    n = value.try_cast("double")
    return F.when(n.isNotNull() & ~F.isnan(n), F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), n))).otherwise(F.lit(float(fallback)))


def whole_in_range(value: Column, low: int, high: int) -> Column:
    """FLT15: a whole number in range, or null."""
    n = value.try_cast("double")
    return F.when((n == F.floor(n)) & n.between(low, high), n.cast("int"))


def sane_style(style: Column) -> Column:
    """FLT16: every field in its range or at its default."""
    one_of = lambda c, values: F.when(c.isin(*values), c).otherwise(values[0])
    return F.struct(
        F.struct(clamp(style["borderRadius"]["window"], 0, 32, 24).alias("window"), clamp(style["borderRadius"]["bubble"], 0, 32, 32).alias("bubble")).alias("borderRadius"),
        one_of(style["position"], ("bottom-right", "bottom-left", "top-right", "top-left")).alias("position"),
        one_of(style["sizePreset"], ("standard", "compact", "large")).alias("sizePreset"),
        F.struct(clamp(style["glass"]["blur"], 0, 40, 24).alias("blur"), clamp(style["glass"]["saturate"], 100, 300, 200).alias("saturate"), clamp(style["glass"]["opacity"], 0, 0.4, 0.12).alias("opacity")).alias("glass"),
    )


def sane_questions(questions: Column, most: int = 6, chars: int = 120) -> Column:
    """FLT16."""
    kept = F.filter(F.transform(questions, lambda q: F.substring(T.trimmed(q), 1, chars)), lambda q: q.isNotNull() & (q != ""))
    return F.coalesce(F.slice(kept, 1, most), F.array().cast("array<string>"))


def sane_welcome(welcome: Column, chars: int = 500) -> Column:
    return F.substring(T.trimmed(F.coalesce(welcome, F.lit(""))), 1, chars)


def sane_logo(logo: Column) -> Column:
    logo = T.trimmed(logo)
    return F.when(logo.rlike("^/(uploads|Loghi)/[^/]+$") & ~logo.contains(".."), logo).otherwise("")


def sufficient(phones: Column, emails: Column, text: Column, services: Column, forms: Column, links: Column) -> Column:
    """FLT17: two strong signals, or a form or link."""
    some = lambda a: F.coalesce(F.size(a), F.lit(0)) > 0
    strong = (some(phones) | some(emails)).cast("int") + (F.coalesce(F.length(text), F.lit(0)) > 500).cast("int") + some(services).cast("int")
    return (strong >= 2) | some(forms) | some(links)


def is_vat_like(phone: Column) -> Column:
    """FLT18: ten digits or more and nothing else."""
    return F.regexp_replace(phone, r"\s+", "").rlike(r"^\d{10,}$")


def is_invalid_address(address: Column) -> Column:
    return ~(any_of(address, ("Via", "Piazza", "Corso", "Viale", "Strada")) & address.rlike(r"\d{5}") & address.rlike("[A-Z][a-z]+"))


def is_plausible(phones: Column, emails: Column, addresses: Column, text: Column) -> Column:
    """FLT18: nothing in a result looks made up."""
    made_up = r"protocollo@.*\.it$|posta@.*\.it$|pec\.comune\.|Piazza Municipio, \d+"
    odd = lambda a, f: F.coalesce(F.exists(a, f), F.lit(False))
    short = F.coalesce(F.length(text).between(1, 99), F.lit(False))
    return ~(odd(emails, lambda e: e.rlike(made_up)) | odd(addresses, lambda a: a.rlike(made_up) | is_invalid_address(a)) | odd(phones, is_vat_like) | short)
