"""Classes of stored pages and of crawl-log entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bizcontacts.functions.text import col, contains_any

# Phrases of consent pages.
CONSENT_URL = "consent.google"
CONSENT_PHRASES = (
    "before you continue to google",
    "zanim przejdziesz do google",
    "bevor sie zu google weitergehen",
    "avant de continuer vers google",
    "prima di continuare su google",
    "antes de continuar en google",
    "antes de continuar para o google",
    "voordat je doorgaat naar google",
    "for du fortsaetter til google",
    "for du fortsetter til google",
    "innan du fortsatter till google",
    "ennen kuin jatkat googleen",
    "qabel tkompli fuq google",
    "než přejdete na google",
    "predtým, než prejdete na google",
    "mielőtt továbblépne a google-ra",
    "preden nadaljujete v google",
    "prije nego što nastavite na google",
    "пре него што наставите на google",
    "para se të vazhdoni në google",
    "пред да продолжите на google",
    "преди да продължите към google",
    "înainte de a continua pe google",
    "προτού συνεχίσετε στην google",
    "we use cookies",
    "używamy plików cookie",
    "nous utilisons des cookies",
    "utilizziamo i cookie",
    "usamos cookies",
    "utilizamos cookies",
    "wij gebruiken cookies",
    "vi bruger cookies",
    "vi anvander cookies",
    "vi bruker cookies",
    "vi bruker informasjonskapsler",
    "kaytamme evasteita",
    "käytämme evästeitä",
    "nuzaw cookies",
    "nużaw cookies",
    "nużaw il-cookies",
    "používáme soubory cookie",
    "používame súbory cookie",
    "cookie-kat használunk",
    "uporabljamo piškotke",
    "koristimo kolačiće",
    "користимо колачиће",
    "përdorim cookie",
    "користиме колачиња",
    "използваме бисквитки",
    "folosim cookie-uri",
    "χρησιμοποιούμε cookies",
)

# Markup and phrases of CAPTCHA pages.
CAPTCHA_MARKUP = (
    r"""<iframe\b[^>]*\bsrc\s*=\s*["'][^"']*recaptcha""",
    r"""<iframe\b[^>]*\btitle\s*=\s*["'][^"']*reCAPTCHA""",
    r"""<div\b[^>]*\bclass\s*=\s*["'][^"']*g-recaptcha""",
    r"""<div\b[^>]*\bid\s*=\s*["'][^"']*captcha""",
    r"""\bclass\s*=\s*["'](?:[^"']*\s)?captcha-container[\s"']""",
    r"""\bid\s*=\s*["']captcha["']""",
)
CAPTCHA_PHRASES = (
    "unusual traffic from your computer network",
    "our systems have detected unusual traffic",
    "we have detected unusual traffic",
    "please show you're not a robot",
)

# Address part and phrases of refusal pages.
BLOCK_URL = "/sorry"
BLOCK_PHRASES = (
    "unusual traffic",
    "detected unusual traffic",
    "automated queries",
    "not a robot",
    "please show you're not a robot",
)

# Phrases of app-upgrade pop-ups.
POPUP_PHRASES = (
    "uaktualnij aplikację",
    "update the app",
    "upgrade to a smarter",
    "open the google maps app",
    "auf das noch smartere",
    "smartere google maps",
    "umsteigen",
    "echtzeit",
    "get real-time",
    "turn-by-turn navigation",
    "get real-time navigation",
    "keep using web",
    "go back to web",
    "stay in browser",
    "mettre à jour",
    "actualizar",
    "aggiorna",
    "aktualisieren",
    "atualizar",
    "bijwerken",
    "opdater appen",
    "uppdatera appen",
    "oppdater appen",
    "paivita sovellus",
    "päivitä sovellus",
    "aggorna l-app",
    "aktualizujte aplikaci",
    "aktualizovať aplikáciu",
    "frissítse az alkalmazást",
    "posodobite aplikacijo",
    "ažurirajte aplikaciju",
    "ажурирајте апликацију",
    "përditëso aplikacionin",
    "ажурирај ја апликацијата",
    "актуализирайте приложението",
    "actualizați aplicația",
    "ενημερώστε την εφαρμογή",
    "wróć do przeglądarki",
    "zurück zur webversion",
    "retour au web",
    "volver a la web",
    "torna alla versione web",
    "voltar à versão web",
    "tilbage til webversionen",
    "tillbaka till webben",
    "tilbake til nettet",
    "palaa verkkoversioon",
    "lura għall-web",
)

# Parts of error messages, and the status codes worth another attempt.
TLS_FATAL_MARKERS = (
    "unexpected eof while reading",
    "eof occurred in violation of protocol",
    "certificate verify failed",
    "wrong version number",
    "sslv3 alert",
    "tlsv1 alert",
    "handshake failure",
    "remote end closed connection without response",
    "remotedisconnected",
)
TRANSIENT_MARKERS = (
    "timeout",
    "net::err",
    "unexpected eof while reading",
    "remote end closed connection",
    "eof occurred in violation of protocol",
    "connection reset",
    "connection aborted",
    "connection refused",
    "ssl",
    "tls",
)
RETRYABLE_STATUS = (429, 500, 502, 503, 504)

PAGE_CLASSES = ("consent", "captcha", "blocked", "popup", "content")
CRAWL_CLASSES = ("tls_fatal", "transient", "retryable_status", "ok", "other")


def is_consent(url: Column, body: Column) -> Column:
    return F.contains(url, F.lit(CONSENT_URL)) | contains_any(body, CONSENT_PHRASES)


def is_captcha(url: Column, title: Column, body: Column, markup: Column) -> Column:
    elements = F.lit(False)
    for pattern in CAPTCHA_MARKUP:
        elements = elements | markup.rlike(f"(?s){pattern}")
    named = F.contains(title, F.lit("captcha")) | F.contains(title, F.lit("robot"))
    return (
        (markup.rlike("(?i)captcha") & elements)
        | contains_any(body, CAPTCHA_PHRASES)
        | (F.contains(url, F.lit("sorry")) & named)
    )


def is_blocked(url: Column, body: Column) -> Column:
    return F.contains(url, F.lit(BLOCK_URL)) | contains_any(body, BLOCK_PHRASES)


def is_popup(body: Column) -> Column:
    return contains_any(body, POPUP_PHRASES)


def page_class(url: Column | str, title: Column | str, body: Column | str, markup: Column | str) -> Column:
    """First class that fits, in the order of ``PAGE_CLASSES``. ``url``, ``title`` and ``body`` are
    expected in lower case, the markup as stored."""
    u, t, b, m = (F.coalesce(col(c), F.lit("")) for c in (url, title, body, markup))
    return (
        F.when(is_consent(u, b), F.lit("consent"))
        .when(is_captcha(u, t, b, m), F.lit("captcha"))
        .when(is_blocked(u, b), F.lit("blocked"))
        .when(is_popup(b), F.lit("popup"))
        .otherwise(F.lit("content"))
    )


def crawl_class(status: Column | str, error: Column | str) -> Column:
    """Class of one attempt; fatal TLS errors are tested before the wider transient markers."""
    low = F.lower(F.coalesce(col(error), F.lit("")))
    return (
        F.when(contains_any(low, TLS_FATAL_MARKERS), F.lit("tls_fatal"))
        .when(contains_any(low, TRANSIENT_MARKERS), F.lit("transient"))
        .when(col(status).isin(*RETRYABLE_STATUS), F.lit("retryable_status"))
        .when(col(status) == 200, F.lit("ok"))
        .otherwise(F.lit("other"))
    )
