"""Text and URL helpers as column expressions."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

def _folding() -> tuple[str, str]:
    """Letters that decompose to one letter and marks, each with that letter, and then the marks, which go."""
    pairs, marks = [], []
    for code in range(0x80, 0x10000):
        c = chr(code)
        if unicodedata.category(c) == "Mn":
            marks.append(c)
            continue
        base = [x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn"]
        if len(base) == 1 and base[0] != c:
            pairs.append((c, base[0]))
    return "".join(c for c, _ in pairs) + "".join(marks), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _folding()


def strip(text: Column) -> Column:
    """Trim any whitespace, not only blanks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


#: Letters whose capital is several letters, with the one letter that stands for it where there is one (themselves otherwise),
#: and letters that got capitals with Unicode 16 only, which stay.
ONE_CAPITAL = {c: "\u1e9e" if c == "\u00df" else c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x110000)) if len(c.upper()) > 1}
ONE_CAPITAL |= {c: c for c in map(chr, (0x19B, 0x264, 0x1C8A, 0xA7CD, 0xA7DB, *range(0x10D70, 0x10D86)))}


def capitals(text: Column) -> Column:
    """Upper case, one letter for one letter: a sharp s becomes a capital sharp s, not two letters."""
    odd = "".join(ONE_CAPITAL)
    one = F.create_map(*[F.lit(x) for kv in ONE_CAPITAL.items() for x in kv])
    parts = F.regexp_extract_all(text, F.lit(f"[{odd}]|[^{odd}]+"), 0)
    return F.when(text.rlike(f"[{odd}]"), F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(one, p), F.upper(p))), "")).otherwise(F.upper(text))


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s+", " "))


def strip_tags(html: Column) -> Column:
    return collapse(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", " "))


#: Elements dropped with their content before text extraction.
#: Elements without visible text (fixed values).
HIDDEN = ("script", "style", "noscript", "header", "footer", "nav", "aside", "form", "svg", "button", "input", "textarea", "select", "option", "label", "iframe")


def visible_text(html: Column) -> Column:
    """Expression form of the main-text extraction: hidden elements, comments and tags removed, entities decoded."""
    out = F.regexp_replace(html, "(?s)<!--.*?-->", " ")
    for tag in HIDDEN:
        out = F.regexp_replace(out, f"(?is)<{tag}(\\s[^>]*)?>.*?</{tag}>", " ")
    return collapse(unescape(F.regexp_replace(out, "(?s)<[^>]+>", " ")))


def unescape(text: Column) -> Column:
    named = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), named, text)



def fold(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1))


def extract_urls(text: Column) -> Column:
    """Distinct URLs in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("(?i)(https?://[^\\s<>\"']+)"), F.lit(1)))


def content_hash(entity: Column, source: Column, kind: Column, url: Column, title: Column, content: Column) -> Column:
    parts = [F.coalesce(c.cast("string"), F.lit("None")) for c in (entity, source, kind)]
    texts = [F.coalesce(c, F.lit("")) for c in (url, title)]
    return F.sha2(F.concat_ws("|", *parts, *texts, F.coalesce(content, F.lit(""))), 256)


#: Sources that are read through another address (fixed values): marker, replacement type, replacement URL.
REWRITES = (
    ("truthsocial.com/@realdonaldtrump", "rss", "https://trumpstruth.org/feed"),
    ("rsshub.app/truthsocial/realdonaldtrump", "rss", "https://trumpstruth.org/feed"),
    ("opec.org/opec_web/en/press_room/", "rss", "https://news.google.com/rss/search?q=site%3Aopec.org%20press%20releases&hl=en-US&gl=US&ceid=US:en"),
)


def rewrite_source(kind: Column, url: Column, rules=REWRITES) -> tuple[Column, Column]:
    lowered = F.lower(F.trim(url))
    new_kind, new_url = F.lower(F.trim(kind)), F.trim(url)
    for marker, to_kind, to_url in reversed(rules):
        hit = lowered.contains(marker.lower())
        new_kind, new_url = F.when(hit, to_kind).otherwise(new_kind), F.when(hit, to_url).otherwise(new_url)
    return new_kind, new_url


#: Text files that are read (fixed values).
TEXT_EXTENSIONS = (".txt", ".md", ".py", ".json", ".js", ".html", ".css")


def allowed_source(source: Column, extensions: tuple[str, ...] = TEXT_EXTENSIONS) -> Column:
    """URLs pass; files need an allowed extension."""
    ext = F.lower(F.regexp_extract(source, r"(\.[^./\\]+)$", 1))
    return F.lower(source).rlike("^https?://") | ext.isin(*extensions)


# ---------------------------------------------------------------- budgets


def tokens(text: Column) -> Column:
    """About four characters per token; at least one for non-empty text."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int")))


def trim_to_tokens(text: Column, limit: Column) -> Column:
    cut = F.substring(text, F.lit(1), (limit * 4).cast("int"))
    worded = F.when(cut.contains(" "), F.regexp_replace(cut, "(?s) [^ ]*$", "")).otherwise(cut)
    return F.when(limit <= 0, "").when(F.length(text) <= limit * 4, text).otherwise(F.concat(worded, F.lit("…")))


def first_lines(text: Column, n: int) -> Column:
    lines = F.split(text, "\n")
    return F.when(F.size(lines) <= n, text).otherwise(F.concat(F.array_join(F.slice(lines, 1, n), "\n"), F.lit(f"\n… [tronqué à {n} lignes]")))


# ---------------------------------------------------------------- language and topics

#: Stop words per language in tie order (fixed values).
STOP_WORDS = {
    "fr": ("le", "la", "les", "des", "et", "est", "je", "vous", "nous"),
    "en": ("the", "and", "is", "are", "you", "with", "for", "to", "of"),
    "de": ("der", "die", "das", "und", "ist", "nicht", "sie", "mit", "für"),
    "it": ("il", "lo", "la", "gli", "le", "e", "non", "con", "per"),
    "es": ("el", "la", "los", "las", "y", "no", "con", "para"),
}


def _hits(text: Column, words) -> Column:
    return reduce(lambda a, b: a + b, [text.contains(w).cast("int") for w in words])


def _best(scores: dict[str, Column], default: str) -> Column:
    """Name with the most hits; ties to the earlier one, ``default`` without hits."""
    top = F.greatest(*scores.values())
    out = F.lit(default)
    for name, score in reversed(scores.items()):
        out = F.when(score == top, name).otherwise(out)
    return F.when(top > 0, out).otherwise(default)


def guess_language(text: Column, default: str = "fr") -> Column:
    padded = F.concat(F.lit(" "), F.lower(strip(F.coalesce(text, F.lit("")))), F.lit(" "))
    return _best({lang: _hits(padded, [f" {w} " for w in words]) for lang, words in STOP_WORDS.items()}, default)


#: Keywords per problem domain (fixed values).
DOMAIN_KEYWORDS = {
    "trading_strategy": ("trading", "stratégie", "strategy", "backtest", "mt5", "metatrader", "forex", "bourse", "action", "crypto", "bitcoin", "eurusd",
                         "indicateur", "rsi", "macd", "moving average", "bollinger"),
    "data_analysis": ("analyse", "données", "data", "csv", "excel", "statistique", "graphique", "visualisation", "corrélation", "régression", "moyenne", "médiane", "distribution"),
    "research": ("recherche", "trouve", "information", "news", "actualité", "wikipedia", "article", "sujet", "explique", "c'est quoi", "qu'est-ce que", "histoire de"),
    "programming": ("code", "programme", "script", "algorithme", "fonction", "python", "trie", "boucle", "récursif", "classe", "bug", "erreur", "debug", "optimise le code"),
    "system_diagnostic": ("système", "diagnostic", "performance", "mémoire", "cpu", "disque", "processus", "service", "réseau", "ping"),
}


def problem_domain(text: Column) -> Column:
    low = F.lower(text)
    return _best({d: _hits(low, words) for d, words in DOMAIN_KEYWORDS.items()}, "generic")


def drop_sources_tail(text: Column) -> Column:
    """Remove a closing "Sources:" section and bracketed reference numbers."""
    return strip(F.regexp_replace(F.regexp_replace(strip(text), r"(?is)\n\s*(?:sources?|références?)\s*:.*$", ""), r"\s*\[\d+\]", ""))


def speakable(text: Column) -> Column:
    """Text for reading aloud: plain quotes, no code blocks, URLs or asterisks."""
    out = F.translate(text, " ’“”«»", " '\"\"\"\"")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)```.*?```", " "), r"https?://\S+", " ")
    return collapse(F.regexp_replace(out, "[*•★☆✱✳✴﹡∗＊]", " "))


def json_field(text: Column, name: str) -> Column:
    """Field of a JSON object; NULL for anything that does not parse."""
    return F.get_json_object(text, f"$.{name}")


#: Event-type labels per interface language (fixed values).
EVENT_LABELS = {
    "fr": {"central_bank_signal": "Banque centrale / Taux", "military_escalation": "Guerre / Conflit", "sanctions": "Sanctions", "commodity_supply": "Pétrole / Énergie",
           "macro_data": "Macro-économie", "market_move": "Marchés", "shipping_accident": "Accident maritime", "person_death": "Décès / Nécrologie", "odd_news": "Insolite", "unknown": "Divers"},
    "en": {"central_bank_signal": "Central bank / Rates", "military_escalation": "War / Conflict", "sanctions": "Sanctions", "commodity_supply": "Oil / Energy",
           "macro_data": "Macro", "market_move": "Markets", "shipping_accident": "Shipping accident", "person_death": "Obituary / Death", "odd_news": "Odd news", "unknown": "Other"},
}


def event_label(event_type: Column, lang: str = "fr") -> Column:
    labels = EVENT_LABELS.get(lang, EVENT_LABELS["fr"])
    table = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.element_at(table, F.coalesce(F.nullif(F.trim(event_type), F.lit("")), F.lit("unknown"))), F.lit(labels["unknown"]))
