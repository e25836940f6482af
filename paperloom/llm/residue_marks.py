"""Marks of template residue and filler in a text."""

from __future__ import annotations

import re

# The delimiters of common template languages, and words that stand for a value not filled in.
TEMPLATE = re.compile(
    r"\{\{.{0,80}?\}\}|\{%.{0,80}?%\}|<%.{0,80}?%>|&lt;%.{0,80}?%&gt;|\$\{[\w.]{1,60}\}|\[\[[\w. ]{1,60}\]\]|%\(\w{1,40}\)[sd]|\{[A-Za-z_]\w{0,40}\}|\{\d{1,2}\}"
    r"|<(?:placeholder|title|name|insert|todo)[^<>]{0,40}>|\[(?:tbc|tbd|tk|todo|insert|your|gallery|quote|photo|image|video|embed|caption|name|date|headline|city|placeholder)\b[^\[\]]{0,60}\]"
    r"|\[object Object\]|\bundefined\b(?= \S)(?=.{0,12}\bNaN\b)|\bNaN\b|\b[a-z]+(?:_[a-z]+)+\b|\bX{2,}\b(?! century)|\bTK ?TK\b|\bT[BK][CD]?\b:|__[A-Z]\w*__|@@\w+@@|%%\w+%%|\$\$\w+\$\$",
    re.IGNORECASE,
)
FILLER = re.compile(
    r"\blorem\b|\bipsum\b|\bdolor sit\b|\b(?:copy|text|headline|story|content|caption|words?) goes here\b|\bdummy (?:copy|text)\b|\bplaceholder (?:copy|text|story)\b|\bsample text\b"
    r"|\bblindtext\b|\bmustertext\b|\btexto de relleno\b|\bfaux texte\b|\btexte factice\b|\basdf\b|\bqwerty?\b|\bx{2,}(?: x+){2,}\b",
    re.IGNORECASE,
)
_REPEATED = re.compile(r"\b(\w+)(?: \1){3,}\b")
# One of these is in every text that FILLER fits; looking for them first spares most texts the search.
_FILLER_HINTS = ("lorem", "ipsum", "dolor sit", "goes here", "go here", "dummy ", "placeholder ", "sample text", "blindtext", "mustertext", "texto de relleno", "faux texte", "texte factice", "asdf", "qwer", "xx x")
_HINT = re.compile(r"[{}\[\]<>%_@$]|NaN|XX|TK|TB[CD]|&lt;")


# Words of error messages, of demands for scripts, cookies, a login or proof of being human, and of
# subscription notices, in English, French, German, Spanish and Bengali.
NOTICE = re.compile(
    r"\b(?:oops|something went wrong|error|traceback|exception|not found|forbidden|denied|unavailable|time[d -]?out|too many requests|bad gateway|no content was returned|taken down|could not be (?:found|loaded|shown)|cannot (?:open|load|be shown)|not offered where you are|planned work)\b"
    r"|\b(?:java ?script|scripts?|cookies are|blocked|captcha|robot|human|log ?in|sign in|session|members?|subscribe|subscription|trial|free (?:\w+ )?stories|plans from|to read on|to go on reading)\b"
    r"|\b(?:erreur|introuvable|refusé|indisponible|abonnez|abonnés?|connectez|activer|fehler|nicht gefunden|verweigert|skripte|einschalten|abonnieren|abo|anmelden|denegado|no encontrad[ao]|active|suscríb\w+|suscriptores|inicie sesión|iniciar sesión)\b"
    r"|ত্রুটি|পাওয়া যায়নি|লগ ?ইন|সাবস্ক্রাইব|জাভাস্ক্রিপ্ট|গ্রাহক হোন|চালু করুন",
)

# Searches over lower-cased texts, in RE2's dialect, that pass everything the exact patterns can fit and little else.
FILLER_HINT = "|".join(_FILLER_HINTS)
RESIDUE_HINT = (
    r"\{\{|\{%|<%|&lt;%|\$\{|\[\[|%\(|\{[a-z_]\w*\}|\{\d|<(?:placeholder|title|name|insert|todo)|\[(?:tbc|tbd|tk|todo|insert|your|gallery|quote|photo|image|video|embed|caption|name|date|headline|city|placeholder|object)"
    r"|\bnan\b|[a-z]_[a-z]|\bxx|\btk ?tk|\bt[bk][cd]?:|__[a-z]|@@|%%|\$\$"
)
NOTICE_HINT = (
    r"oops|went wrong|error|traceback|exception|not found|forbidden|denied|unavailable|time[d -]?out|too many requests|bad gateway|no content was|taken down|could not be|cannot (?:open|load|be shown)|not offered where|planned work"
    r"|script|cookies are|blocked|captcha|robot|human|log ?in|sign in|session|member|subscri|trial|free |plans from|to read on|to go on"
    r"|erreur|introuvable|refus|indisponible|abonn|connectez|activer|fehler|nicht gefunden|verweigert|skripte|einschalten|\babo\b|anmelden|denegado|no encontrad|active|suscr|inicie|iniciar"
    r"|ত্রুটি|পাওয়া যায়নি|লগ|সাবস্ক্রাইব|জাভাস্ক্রিপ্ট|গ্রাহক হোন|চালু করুন"
)


def filler(text: str) -> bool:
    """Whether a text is, or holds, filler: its usual words, or one word again and again."""
    low = text.lower()
    if any(h in low for h in _FILLER_HINTS) and FILLER.search(low):
        return True
    w = low.split()
    return len(w) >= 4 and len(set(w)) * 2 <= len(w) and _REPEATED.search(low) is not None


def notice(text: str) -> bool:
    """Whether a text has words of notices. Such words occur in stories too; a page's other lines must tell."""
    return NOTICE.search(text.lower()) is not None


def residue(text: str) -> str | None:
    """The first template part of a text that is not shown in quotation marks or backticks, if any."""
    if not _HINT.search(text):
        return None
    for m in TEMPLATE.finditer(text):
        before, after = text[max(0, m.start() - 1) : m.start()], text[m.end() : m.end() + 1]
        if not (before and after and before in "`“\"‘'«" and after in "`”\"’'»"):
            return m.group()
    return None


def only_template(text: str) -> bool:
    """Whether a text has nothing but template parts and signs."""
    rest = TEMPLATE.sub("", text)
    return rest != text and not re.search(r"\w", rest)
