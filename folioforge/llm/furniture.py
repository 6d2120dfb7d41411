"""Fixed phrases of page furniture: the labeller of the sample from which problem 1 learns its weights.

It is used on the labelled sample only, never where lines are judged. It knows whole-line phrases, not single words, so a sentence
that merely speaks of cookies or home pages is labelled as body.
"""

from __future__ import annotations

import re

# Entries of navigation menus, by language.
MENU = {
    "en": "Home|Contact|Contact us|About us|About|News|Search|Topics|Library|Legal notice|Accessibility|Publications|"
    "Calendar|Press room|Press|Site map|Sitemap|Log in|Sign in|Login|Register|Help|My account|Subscribe|Vacancies|Careers|"
    "Data protection|Privacy|Privacy policy|A–Z list|A-Z list|Menu|Events|Services|FAQ",
    "es": "Inicio|Contacto|Quiénes somos|Noticias|Buscar|Temas|Biblioteca|Aviso legal|Accesibilidad|Publicaciones|"
    "Agenda|Prensa|Mapa del sitio|Acceder|Ayuda|Mi cuenta|Suscribirse|Empleo|Protección de datos|Privacidad|Menú",
    "fr": "Accueil|Contact|À propos|Actualités|Recherche|Thèmes|Bibliothèque|Mentions légales|Accessibilité|Publications|"
    "Agenda|Presse|Plan du site|Se connecter|Aide|Mon compte|S’abonner|S'abonner|Emplois|Protection des données|Menu",
    "de": "Startseite|Kontakt|Über uns|Aktuelles|Suche|Themen|Bibliothek|Impressum|Barrierefreiheit|Veröffentlichungen|"
    "Kalender|Presse|Übersicht|Anmelden|Hilfe|Mein Konto|Abonnieren|Stellenangebote|Datenschutz|Menü|Rechtliche Hinweise",
    "it": "Home|Contatti|Chi siamo|Notizie|Cerca|Temi|Biblioteca|Note legali|Accessibilità|Pubblicazioni|Calendario|Stampa|"
    "Mappa del sito|Accedi|Aiuto|Il mio account|Iscriviti|Privacy",
    "pt": "Início|Contacto|Contato|Quem somos|Notícias|Pesquisar|Temas|Biblioteca|Aviso legal|Acessibilidade|Publicações|"
    "Agenda|Imprensa|Mapa do sítio|Mapa do site|Entrar|Ajuda|A minha conta|Subscrever",
    "nl": "Home|Contact|Over ons|Nieuws|Zoeken|Onderwerpen|Bibliotheek|Juridische mededeling|Toegankelijkheid|Publicaties|"
    "Agenda|Pers|Sitemap|Inloggen|Help|Mijn account|Abonneren|Vacatures",
    "pl": "Strona główna|Kontakt|O nas|Aktualności|Szukaj|Tematy|Biblioteka|Nota prawna|Dostępność|Publikacje|Kalendarz|"
    "Prasa|Mapa strony|Zaloguj|Zaloguj się|Pomoc|Moje konto|Subskrybuj",
    "el": "Αρχική|Αρχική σελίδα|Επικοινωνία|Ποιοι είμαστε|Νέα|Αναζήτηση|Θέματα|Βιβλιοθήκη|Νομική σημείωση|Προσβασιμότητα|"
    "Δημοσιεύσεις|Ημερολόγιο|Τύπος|Χάρτης ιστοτόπου|Σύνδεση|Βοήθεια|Ο λογαριασμός μου|Εγγραφή",
    "sv": "Startsida|Hem|Kontakt|Om oss|Nyheter|Sök|Ämnen|Bibliotek|Rättsligt meddelande|Tillgänglighet|Publikationer|"
    "Kalender|Press|Webbkarta|Logga in|Hjälp|Mitt konto|Prenumerera",
}
# Headings of side boxes.
BOX = (
    "Related pages|Related links|Quick links|You may also like|In this section|Most read|Most read this week|Latest notices|"
    "Páginas relacionadas|Enlaces rápidos|También le puede interesar|En esta sección|Lo más leído|Últimos avisos|"
    "Pages liées|Liens rapides|Vous aimerez aussi|Dans cette rubrique|Les plus lus|Derniers avis|"
    "Verwandte Seiten|Schnellzugriff|Das könnte Sie auch interessieren|In diesem Bereich|Meistgelesen|Neueste Mitteilungen|"
    "Pagine correlate|In questa sezione|I più letti|Páginas relacionadas|Nesta secção|Mais lidos|Verwante pagina's|"
    "In deze rubriek|Meest gelezen|Powiązane strony|W tym dziale|Najczęściej czytane|Σχετικές σελίδες|Σε αυτή την ενότητα|"
    "Τα πιο δημοφιλή|Relaterade sidor|I detta avsnitt|Mest lästa"
)
# Buttons of consent notices.
BUTTON = (
    "Accept all|Reject all|Reject|Accept only essential|Manage settings|OK, got it|I agree|Aceptar todo|Rechazar|Configurar|"
    "Tout accepter|Refuser|Gérer mes choix|Alle annehmen|Ablehnen|Auswahl ändern|Accetta tutto|Rifiuta|Aceitar tudo|"
    "Recusar|Alles accepteren|Weigeren|Akceptuj wszystko|Odrzuć|Αποδοχή όλων|Απόρριψη|Godkänn alla|Avvisa"
)
# Whole-line patterns of skip links, prompts and page footers.
LINE = [
    r"(skip|jump) to (main )?content", r"ir al contenido( principal)?", r"aller au contenu( principal)?", r"zum (haupt)?inhalt springen",
    r"vai al contenuto", r"ir para o conteúdo", r"naar de inhoud", r"przejdź do treści", r"μετάβαση στο περιεχόμενο", r"hoppa till innehållet",
    r"back to (the )?top", r"volver arriba", r"haut de page", r"retour en haut( de page)?", r"nach oben", r"torna su", r"voltar ao topo", r"naar boven", r"do góry", r"till toppen",
    r"share this page( by e-?mail)?", r"compartir esta página", r"partager cette page", r"diese seite (weiterempfehlen|teilen)",
    r"print this page", r"imprimir esta página", r"imprimer cette page", r"(diese )?seite drucken",
    r"was this page useful\?.*", r"¿le ha sido útil esta página\?.*", r"cette page vous a-t-elle été utile ?\?.*", r"war diese seite hilfreich\?.*",
    r"last updated ?: ?[\d./-]+", r"última actualización ?: ?[\d./-]+", r"dernière mise à jour ?: ?[\d./-]+", r"letzte (änderung|aktualisierung) ?: ?[\d./-]+",
    r"page managed by \S.{0,60}", r"page \d+ of the .{1,60} web archive", r"build \d+(\.\d+)*", r"terms of use( · privacy)?( · cookies)?",
    r"follow .{1,60} on social (channels|media)", r".{1,60} is not responsible for external links\.?",
    r"(sign up for|subscribe to) the .{1,60} newsletter", r"suscríbase al boletín de .{1,60}", r"abonnez-vous à la lettre .{1,60}", r"newsletter von .{1,60} abonnieren",
    r"(©|\(c\)|copyright) ?\d{4}.{1,60}\. (all rights reserved|todos los derechos reservados|tous droits réservés|alle rechte vorbehalten|tutti i diritti riservati|todos os direitos reservados|alle rechten voorbehouden|wszelkie prawa zastrzeżone|alla rättigheter förbehållna)\.?",
]
#: A longer line is no skip link, prompt or footer; menus, breadcrumbs and consent notices are of any length.
LINE_CHARS = 400
# Signs that separate the entries of a menu, and the steps of a breadcrumb.
MENU_SEP, CRUMB_SEP = r"\s+[•·|/]\s+|\s{2,}|\t+", r"\s[›»>→]\s"

_menu = {x.lower() for v in MENU.values() for x in v.split("|")}
_box = {x.lower() for x in BOX.split("|")}
_line = re.compile("|".join(f"(?:{x})" for x in LINE), re.I)
_button = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(BUTTON.split("|"), key=len, reverse=True))) + r")(?!\w)")
_menu_sep, _crumb_sep = re.compile(MENU_SEP), re.compile(CRUMB_SEP)


def seed(line: str) -> str | None:
    """Kind of furniture that a whole line is by the fixed phrases, or None."""
    s = line.strip()
    low = s.lower()
    if low in _menu:
        return "menu"
    if low.rstrip(":") in _box:
        return "box"
    if len(s) <= LINE_CHARS and _line.fullmatch(s):
        return "prompt"
    at = _crumb_sep.search(s)
    if at and s[: at.start()].rstrip().lower() in _menu:
        return "crumb"
    parts = _menu_sep.split(s)
    if len(parts) > 1 and sum(p.lower() in _menu for p in parts) * 2 > len(parts):
        return "menu"
    if len(_button.findall(s)) >= 2:
        return "consent"
    return None
