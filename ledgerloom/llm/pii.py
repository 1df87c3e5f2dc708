"""Personal data in free text: found by voting labelers, replaced by typed placeholders.

Patterns, gazetteers and context words each vote on candidate spans. Votes are counted by pattern over all rows;
``weak`` estimates how reliable each labeler is and trains the classifier that decides on the spans. Words of a
receipt are put together in reading order first, in blocks of bounded size that overlap, so an item spread over
several words is one span.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.lookalikes import SUSPICIOUS, doubtful_runs, plain_form
from ledgerloom.llm.names import LEGAL, NICKNAMES, TITLES, fold_name, glued_trade, trade_of
from ledgerloom.llm.weak import decide

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}
#: Labelers of each kind, least bit first; a plus marks precise ones, a minus speaks against the kind.
LABELERS = {
    "email": ("+at_sign", "+written_at", "label", "domain", "known_name"),
    "phone": ("international", "area_code", "label", "grouped", "full_length", "-other_label"),
    "id_number": ("ahv", "+ahv_check", "iban", "+iban_check", "label", "passport", "-other_label"),
    "address": ("+street", "postcode", "+place", "both", "label", "alone", "-year"),
    "name": ("given", "surname", "ending", "label", "+title", "initial", "several", "-company", "-lone"),
}
BLOCK, LAP = 512, 24  #: words of a receipt read at once, and how many more on either side
SENT_NAMES = 8_000_000  #: names of a gazetteer that are sent to the workers at 8 bytes each; of more, those the texts have
#: What the classifier knows of a span besides the votes.
FEATURES = ("long", "upper", "begins_line", "digits")

# Words around personal data in receipts.
NAME_LABELS = {"name", "kontoinhaber", "zugunsten", "person", "arbeitnehmer/in", "arbeitnehmer", "versicherte", "an", "durch", "titulaire", "intestatario", "nom", "nome", "kind", "inhaber", "patient", "spender", "eigentuemer", "versicherter", "beguenstigter"}
SALUTATIONS = {"herr", "herrn", "frau", "hr", "fr", "mme", "madame", "monsieur", "signor", "signora", "sig", "familie", "mlle", "mr", "mrs", "ms", "famille", "famiglia"}
COMMON = set(
    "kopie rueckfragen bemerkung bemerkungen zahlung unter ab und an durch von bis per mit fuer die der das den siehe konto iban ahv ahv-nr no avs sozialvers liegenschaft parzelle "
    "lohnausweis rentenbescheinigung rente zins zins- saldo saldobestaetigung bruttolohn nettolohn beitraege berufliche vorsorge bruttoertrag verrechnungssteuer praemien kvg vvg selbst getragene kosten "
    "total betreuung franken schuldzinsen schuldsaldo spendentotal kurskosten rechnungstotal einbezahlter betrag steuerwert anspruch vst zinsausweis attestation certificat bescheinigung bestaetigung "
    "kindertagesstaette steuerbescheinigung praemienbescheinigung telefon tel fax mobile kontakt e-mail mail kontonummer kontokorrent police police-nr geschaeftsfall zuwendungsbescheinigung vorsorgebeitraege "
    "form wertschriftenverzeichnis mwst valor isin referenz menge artikel stk spendenbestaetigung hypothek zinsbestaetigung honorarrechnung quittung weiterbildung rueckforderungsbeleg kursrechnung "
    "betreuungskosten rechnung unterhalt handwerkerrechnung neue adresse ertraege uebertrag zeitraum leistung periode steuerperiode reglement kanton vermoegen abschluss quartal uebersicht gebuehren valuta "
    "faelligkeit ausfertigung auszug beilage datum unterschrift rundung skonto mahnung ziffer waehrung anteil hinweis detail zwischentotal seite oeffnungszeiten kundennummer genehmigt buchung original formular "
    "gueltigkeit rueckseite rueckerstattung impot recu coordonnees briefkopf abrechnungsperiode steuerausweis mandat pass pass-nr ausweis ausweis-nr vorgelegt satz chf fr eur usd institut firma aussteller arbeitgeber "
    "steuerverzeichnis depot bank saeule sozialvers.-nr ahv-nummer nr nummer abzug alv nbu bvg jahr januar februar maerz april mai juni juli august september oktober november dezember arbeitnehmer/in person versicherte name kontoinhaber zugunsten "
    "brutto netto lohn steuer salaire interets net montant date periode_von dossier beleg".split()
)
STREETS = "strasse|straße|str|gasse|gässli|gaessli|weg|platz|rain|quai|allee|matte|acker|halde|steig|ring|hof|dorf|grund|weiher|feld|berg|park|graben|ufer|brücke|bruecke|tor|markt|wiese|garten|hang|hügel|bühl|promenade|winkel|stieg|wald|bach|gässchen|zelg|rüti|moos|hofstatt|terrasse"
AREA_CODES = set("021 022 024 026 027 031 032 033 034 041 043 044 052 055 056 058 061 062 071 074 075 076 077 078 079 081 091 051 086 080 084 090".split())

_SUSPICIOUS = re.compile(SUSPICIOUS)
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"\d")
_NO_MARKS = {n: "x" for n in range(0xC0, 0x250)}  #: Latin letters with marks count as plain ones
_TOKEN = re.compile(r"\S+")
_BLANKS = re.compile(r" {2,}")

_MAIL = re.compile(
    r"(?P<local>[\w.+%-]+)(?:(?P<at> ?@ ?)|(?P<written> ?[\[(] ?at ?[\])] ?))(?P<domain>[\w-]+(?:(?:\.| ?[\[(] ?(?:dot|punkt) ?[\])] ?)[\w-]+)*(?:\.| ?[\[(] ?(?:dot|punkt) ?[\])] ?)[^\W\d_]{2,})",
    re.I,
)
_WRITTEN_AT = re.compile(r"[\[(] ?at ?[\])]", re.I)  #: as in _MAIL
_PHONE = re.compile(
    r"(?<![\w.'/+-])(?:(?P<inter>(?:\+|00) ?(?:41|423|49|43|33|39) ?(?:\(0\) ?)?\(?\d{2}\)?)|(?P<nat>\(0\d{2}\)|0\d{2}))(?P<rest>(?:[ ./-]?\d{3}[ ./-]?\d{2}[ ./-]?\d{2}))(?![\d'])(?!\.\d)"
)
#: What any number of a person has, and any house number or postcode with a place: cheap tests before the patterns.
_LONG_NUMBER = re.compile(r"\d[\d .()/-]{7,}\d|[A-Z]\d{7}")
_HOUSE_OR_CODE = re.compile(r"[^\W\d_.’'-]\.?,? \d{1,3} ?[a-zA-Z]?(?![\w.'])|\d{4} ?[A-ZÄÖÜ]")
_AHV = re.compile(r"(?<![\d.])756[ .-]{0,2}\d{4}[ .-]{0,2}\d{4}[ .-]{0,2}\d{2}(?![\d'])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])(?:(?P<ch>(?:CH|LI)\d{2}(?:[ -]?[0-9A-Z]){17})|(?P<other>(?:DE|AT|FR|IT|GB|NL|BE|ES|LU|PT)\d{2}(?:[ -]?[0-9A-Z]){11,27}))(?![A-Za-z0-9])", re.I)
_PASSPORT = re.compile(r"(?<![\w-])[A-Z]\d{7}(?!\w)")
_STREET = re.compile(
    r"(?<![\w])(?:(?P<name>(?:(?:Obere[rs]?|Untere[rs]?|Alte[rs]?|Neue[rs]?|Hintere[rs]?|Vordere[rs]?|Äussere[rs]?|Innere[rs]?|Mittlere[rs]?|Grosse[rs]?|Kleine[rs]?|St\.|Sankt) )?"
    rf"(?:[A-ZÄÖÜÉÈ][\w'’-]*?(?:{STREETS})\.?|(?:{'|'.join(s.capitalize() for s in STREETS.split('|'))})\.?))"
    r"|(?P<fore>(?:Rue|Route|Chemin|Avenue|Ave\.|Av\.|Place|Quai|Impasse|Allée|Boulevard|Bd\.|Via|Vicolo|Piazza|Corso|Viale|Strada|Am|Im|An der|An den|Auf der|Auf dem|In der|Bei der|Beim|Zum|Zur|Unter der)(?: (?:de la|de l'|des|du|de|della|del|dei|la|le|les|d'|l'|al|alla))?(?: ?[A-ZÄÖÜÉÈ][\w'’-]+){1,2}))"
    r",? (?P<no>\d{1,3} ?[a-zA-Z]?)(?![\w.'])(?!/\d)",
    re.U,
)
_STREET_UPPER = re.compile(rf"(?<!\w)(?P<name>[A-ZÄÖÜ][A-ZÄÖÜ'-]*(?:{STREETS.upper()})\.?),? (?P<no>\d{{1,3}} ?[A-Za-z]?)(?![\w.'])(?!/\d)")
_POSTCODE = re.compile(r"(?<![\w.'/+-])(?:(?P<land>CH|FL|D|A|F|I)[- ]{1,2})?(?P<code>[1-9]\d{3}) ?(?P<place>[A-ZÄÖÜ][a-zäöüéèâ]+(?:[- ][A-ZÄÖÜ][a-zäöüéèâ]+)?|[A-ZÄÖÜ]{4,})(?!\w)")
_PLACE_END = re.compile(r"(?:ikon|wil|wyl|bueel|büel|buel|bühl|dorf|hofen|lingen|ingen|matt|stetten|berg|burg|bach|au|ach|thal|tal|egg|feld|kirch|brugg|brücken|furt|ried|see|münster|fingen|hausen|heim|nau|ens|ans|ier|eux|ge|zig|zürich|bern|basel|genf|lausanne|luzern|chur|zug|lugano|locarno|thun|biel)$", re.I)
_FIRST_PLACE = re.compile(r"(?:ikon|wil|wyl|bueel|büel|dorf|hofen|lingen|matt|stetten)$", re.I)
_MAIL_LABEL = re.compile(r"(?:e-?mail|mail|kontakt|kopie an|adresse|courriel|posta)\W*$", re.I)
_PHONE_LABEL = re.compile(r"(?:tel|telefon|tél|téléphone|phone|fax|mobile|mobil|natel|handy|unter|rückfragen|anruf)\W*$", re.I)
_ID_LABEL = re.compile(r"(?:ahv|avs|avs-nr|sozialvers|iban|konto|kontokorrent|ab|pass|ausweis|identitätskarte|id|passport|nr|nummer|no|n°)\W*$", re.I)
_PASS_LABEL = re.compile(r"(?:pass|ausweis|reisepass|identitätskarte|identität|id|passport|passeport|carte d'identité|carta d'identità|passaporto)(?:[- ]?(?:nr|no|nummer|n°|number))?\W*$", re.I)
_OTHER_LABEL = re.compile(r"(?:artikel|referenz|police|police-nr|mandat|valor|isin|mwst|che|geschäftsfall|parzelle|rechnung|dossier|vertrag|kundennummer|steuerausweis)\W*(?:nr\W*)?$", re.I)
_ADDRESS_LABEL = re.compile(r"(?:adresse|wohnhaft|liegenschaft|domizil|wohnort|anschrift|ab \d\d\.\d\d\.\d{4})\W*$", re.I)


def cleaned(text: str) -> str:
    """The plain form of a text, mixed-script words in Latin letters, single blanks; of the same words."""
    t = _plain_text(text)
    return _BLANKS.sub(" ", t) if "  " in t else t


def _plain_text(text: str) -> str:
    if text.isascii() or not _SUSPICIOUS.search(text):
        return text
    t = plain_form(text)
    if t.isascii() or not _SUSPICIOUS.search(t):
        return t
    latin = {r: c for r, c, _ in doubtful_runs(t) if c.translate(_NO_MARKS).isascii()}
    return _LETTERS.sub(lambda m: latin.get(m[0], m[0]), t) if latin else t


def name_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word)


class Names:
    """A set of names as sorted 64-bit hashes: of N names, a word that is none is taken for one once in 2**64 / N."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes

    def __contains__(self, word: str) -> bool:
        h = np.uint64(name_hash(word))
        at = int(np.searchsorted(self.hashes, h))
        return at < len(self.hashes) and bool(self.hashes[at] == h)


def _ahv_ok(digits: str) -> bool:
    return len(digits) == 13 and (10 - sum(int(d) * (3 if i % 2 else 1) for i, d in enumerate(digits[:12])) % 10) % 10 == int(digits[12])


def _iban_ok(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


GIVEN, SURNAME, ENDING, LABEL, TITLE, INITIAL, SHAPE, COMPANY, STOP, BREAK, FOREIGN = (1 << i for i in range(11))


class Scanner:
    """Candidate spans with votes in a text; what is known of a token is remembered."""

    def __init__(self, given: np.ndarray, surnames: np.ndarray, endings: frozenset[str] = frozenset()):
        self.given, self.surnames, self.endings = Names(given), Names(surnames), endings
        self.known: dict[str, int] = {}

    def token(self, raw: str) -> int:
        """What a token is, as flags."""
        f = self.known.get(raw)
        if f is None:
            if len(self.known) > 300_000:
                self.known.clear()
            f = self.known[raw] = self._token(raw)
        return f

    def _token(self, raw: str) -> int:
        word = raw.strip(".,;:()<>«»\"'!?")
        dotted = raw.rstrip(",;:)").endswith(".")
        low = fold_name(word)
        f = BREAK if raw[-1:] in ",;:)" else 0
        if not word:
            return STOP
        if not low.isascii():
            return f | STOP | FOREIGN
        parts = low.split(".") if dotted or "." in word else [low]
        if all(p in TITLES or p in SALUTATIONS for p in parts) and (dotted or len(low) > 2) and low not in SALUTATIONS - TITLES:
            return f | TITLE
        if low in SALUTATIONS:
            return f | TITLE
        if low in NAME_LABELS:
            f |= LABEL
        if low in COMMON or low in NAME_LABELS:
            return f | STOP
        if low in LEGAL and len(low) > 1 or low in ("&", "a.g", "s.a", "g.m.b.h") or trade_of(low, dotted) and not (len(low) > 4 and low in self.surnames):
            return f | COMPANY
        if any(c.isdigit() for c in word) or "@" in word or "/" in word:
            return f | STOP
        if not word[0].isalpha() or not word.replace("-", "").replace("'", "").replace("’", "").replace(".", "").isalpha():
            return f | STOP
        if len(word) <= 2 and word[0].isupper() and dotted and (len(word) == 1 or word[1] == "."):
            return f | INITIAL
        pieces = [p for p in re.split(r"[-. ]", low) if p]
        inner = [fold_name(p) for p in re.findall(r"[A-ZÄÖÜÉÈÁÍ][^A-ZÄÖÜÉÈÁÍ]+", word)] if not word.isupper() and "-" not in word else []
        glued = re.findall(r"[A-ZÄÖÜÉÈÁÍ][^A-ZÄÖÜÉÈÁÍ-]*(?:-[A-ZÄÖÜÉÈÁÍ][^A-ZÄÖÜÉÈÁÍ-]*)?", word) if not word.isupper() else []
        given = low in NICKNAMES or low in NICKNAMES_LONG or any(p in self.given for p in pieces) or len(inner) > 1 and inner[0] in self.given
        surname = any(p in self.surnames for p in pieces) or len(inner) > 1 and any(p in self.surnames for p in inner)
        if len(glued) > 1 and not given:
            given = any(q in self.given for g in glued for q in fold_name(g).split("-"))
            surname = surname or any(q in self.surnames for g in glued for q in fold_name(g).split("-"))
        if given:
            f |= GIVEN
        if surname:
            f |= SURNAME
        if word[0].isupper() and len(word) > 2 or (given or surname) and len(word) > 2:
            if glued_trade(low) and not surname:
                return f | COMPANY
            f |= SHAPE
            if low[-ENDING_LETTERS:] in self.endings:
                f |= ENDING
        else:
            f |= STOP
        return f

    def spans(self, text: str) -> list[tuple[int, int, str, int]]:
        """(start, end, kind, votes) of the candidates in a cleaned text; features of the span above the votes."""
        out: list[tuple[int, int, str, int]] = []
        if "@" in text or ("(" in text or "[" in text) and _WRITTEN_AT.search(text):
            self._mail(text, out)
        if _LONG_NUMBER.search(text):
            self._numbers(text, out)
        if _HOUSE_OR_CODE.search(text):
            self._address(text, out)
        self._names(text, out, [(a, b) for a, b, kind, _ in out if kind == "email"])
        return [(a, b, kind, votes | _features(text, a, b) << len(LABELERS[kind])) for a, b, kind, votes in out]

    def _mail(self, text: str, out: list) -> None:
        for m in _MAIL.finditer(text):
            start = m.start()
            head = text[:start]
            line = head[head.rfind("\n") + 1 :]
            before = line.split(" ")
            while len(before) > 1 and before[-1] == "" and before[-2] and self.token(before[-2]) & GIVEN and before[-2][-1:] not in ".,:;":
                start -= len(before[-2]) + 1  # a local part with a blank between given names
                before = before[:-2] + [""]
            votes = (m["at"] is not None) | (m["written"] is not None) << 1 | bool(_MAIL_LABEL.search(text[max(0, start - 20) : start].rstrip(" <"))) << 2
            votes |= ("." in m["domain"] or "dot" in m["domain"].lower()) << 3
            votes |= any(p in self.given or p in self.surnames for p in re.split(r"[^a-z]+", fold_name(m["local"])) if p) << 4
            out.append((start, m.end(), "email", votes))

    def _numbers(self, text: str, out: list) -> None:
        taken = []
        if "756" in text:
            for m in _AHV.finditer(text):
                votes = 1 | _ahv_ok(re.sub(r"\D", "", m[0])) << 1
                votes |= bool(_ID_LABEL.search(text[max(0, m.start() - 24) : m.start()])) << 4 | bool(_OTHER_LABEL.search(text[max(0, m.start() - 24) : m.start()])) << 6
                out.append((m.start(), m.end(), "id_number", votes))
                taken.append((m.start(), m.end()))
        for m in _IBAN.finditer(text):
            code = re.sub(r"[ -]", "", m[0]).upper()
            if sum(c.isdigit() for c in code) < 12:
                continue
            votes = 1 << 2 | _iban_ok(code) << 3 | bool(_ID_LABEL.search(text[max(0, m.start() - 24) : m.start()])) << 4
            out.append((m.start(), m.end(), "id_number", votes | bool(_OTHER_LABEL.search(text[max(0, m.start() - 24) : m.start()])) << 6))
            taken.append((m.start(), m.end()))
        for m in _PASSPORT.finditer(text):
            votes = 1 << 5 | bool(_PASS_LABEL.search(text[max(0, m.start() - 30) : m.start()])) << 4 | bool(_OTHER_LABEL.search(text[max(0, m.start() - 24) : m.start()])) << 6
            if votes >> 4 & 1:
                out.append((m.start(), m.end(), "id_number", votes))
        for m in _PHONE.finditer(text):
            if any(a < m.end() and m.start() < b for a, b in taken):
                continue
            head = text[max(0, m.start() - 24) : m.start()]
            code = "0" + re.sub(r"\D", "", m["inter"])[-2:] if m["inter"] else re.sub(r"\D", "", m["nat"])
            votes = (m["inter"] is not None) | (code in AREA_CODES) << 1 | bool(_PHONE_LABEL.search(head)) << 2
            votes |= bool(re.search(r"[ ./-]", m["rest"])) << 3 | (len(re.sub(r"\D", "", m["rest"])) == 7) << 4 | bool(_OTHER_LABEL.search(head)) << 5
            out.append((m.start(), m.end(), "phone", votes))

    def _address(self, text: str, out: list) -> None:
        streets = [(m.start(), m.end()) for m in _STREET.finditer(text) if not _STOP_STREET(m)]
        mixed = [*streets]
        streets += [(m.start(), m.end()) for m in _STREET_UPPER.finditer(text) if not _STOP_STREET(m) and not any(a < m.end() and m.start() < b for a, b in mixed)]
        places = []
        for m in _POSTCODE.finditer(text):
            place = fold_name(m["place"])
            word = place.split("-")[0].split(" ")[0]
            if word in COMMON or word in NAME_LABELS:
                continue
            known = bool(_FIRST_PLACE.search(word))
            year = 1900 <= int(m["code"]) <= 2099 and not m["land"]
            near = any(0 <= m.start() - b <= 3 for _, b in streets)
            if not known and not near and not m["land"]:
                if year or not _PLACE_END.search(word):
                    continue
            end = m.start("place") + len(re.split(r"[- ]", m["place"])[0]) if " " in m["place"] and not _PLACE_END.search(fold_name(m["place"].split(" ")[-1])) else m.end()
            places.append((m.start(), end, known, year))
        for a, b in streets:
            both = any(0 <= p[0] - b <= 3 for p in places)
            votes = 1 | both << 3 | bool(_ADDRESS_LABEL.search(text[max(0, a - 24) : a])) << 4
            votes |= (a == 0 or text[a - 1] == "\n") << 5
            out.append((a, b, "address", votes))
        for a, b, known, year in places:
            both = any(0 <= a - s[1] <= 3 for s in streets)
            votes = 1 << 1 | known << 2 | both << 3 | bool(_ADDRESS_LABEL.search(text[max(0, a - 24) : a])) << 4 | (year and not known and not both) << 6
            out.append((a, b, "address", votes))

    def _names(self, text: str, out: list, taken: list[tuple[int, int]]) -> None:
        token = self.token
        for line_start, line in _lines(text):
            found = [(m[0], line_start + m.start()) for m in _TOKEN.finditer(line)]
            raws, starts = [r for r, _ in found], [at for _, at in found]
            flags = [token(r) for r in raws]
            any_of = 0
            for f in flags:
                any_of |= f
            if not any_of & (GIVEN | SURNAME | TITLE | LABEL | INITIAL):
                continue
            for a, b in taken:
                for x, at in enumerate(starts):
                    if at < b and a < at + len(raws[x]):
                        flags[x] = STOP
            n, i = len(raws), 0
            while i < n:
                f = flags[i]
                if not f & (SHAPE | INITIAL) or f & (STOP | COMPANY):
                    i += 1
                    continue
                j = i
                while j < n and flags[j] & (SHAPE | INITIAL) and not flags[j] & (STOP | COMPANY) and j - i < 5:
                    j += 1
                    if flags[j - 1] & BREAK and not (j < n and flags[j] & (SHAPE | INITIAL) and not flags[j] & (STOP | COMPANY)):
                        break
                self._name(raws, flags, starts, i, j, line, out)
                i = j
        return

    def _name(self, raws: list[str], flags: list[int], starts: list[int], i: int, j: int, line: str, out: list) -> None:
        seq = flags[i:j]
        all_of = 0
        for f in seq:
            all_of |= f
        k = i - 1
        title = False
        while k >= 0 and flags[k] & (TITLE | FOREIGN):
            title = title or bool(flags[k] & TITLE)
            k -= 1
        label = k >= 0 and bool(flags[k] & LABEL)
        if k >= 1 and not label and fold_name(raws[k]) == "und" and any("@" in r or "at]" in r or "(at" in r for r in raws[:k]):
            label = True
        after = j < len(flags) and bool(flags[j] & TITLE) and fold_name(raws[j].strip(".,;:()")).split(".")[0] not in SALUTATIONS
        company = j < len(flags) and bool(flags[j] & COMPANY) or k >= 0 and bool(flags[k] & COMPANY) and not (title or all_of & GIVEN and all_of & SURNAME)
        company = company or j + 1 < len(flags) and bool(flags[j + 1] & COMPANY) and not flags[j] & (STOP | TITLE)
        several = j - i > 1 or any(re.search(r"[a-zäöüé][A-ZÄÖÜ]", r) for r in raws[i:j])
        lone = not several and not label and not title and not after
        if not (all_of & (GIVEN | SURNAME) or label or title or after or all_of & INITIAL and several):
            return
        votes = bool(all_of & GIVEN) | bool(all_of & SURNAME) << 1 | bool(all_of & ENDING) << 2 | label << 3 | (title or after) << 4
        votes |= bool(all_of & INITIAL) << 5 | several << 6 | company << 7 | lone << 8
        end = starts[j - 1] + len(raws[j - 1])
        out.append((starts[i], end, "name", votes))


def _features(text: str, a: int, b: int) -> int:
    """The bits of ``FEATURES`` of a span."""
    span = text[a:b]
    return (span.count(" ") > 1) | span.isupper() << 1 | (a == 0 or text[a - 1] == "\n") << 2 | (_DIGIT.search(span) is not None) << 3


NICKNAMES_LONG = {n for full in NICKNAMES.values() for n in full}


def _STOP_STREET(m: re.Match) -> bool:
    word = fold_name((m["name"] or m["fore"]).split(" ")[-1].rstrip("."))
    return word in COMMON and word not in ("hof", "ring", "weg", "platz")


def _lines(text: str) -> list[tuple[int, str]]:
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, line))
        at += len(line) + 1
    return out


ENDING_LETTERS, ENDING_NAMES = 3, 3  #: an ending is that of names if so many different ones have it


def _parts(people: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(w): the folded parts of three letters and more of the names in ``columns``, each once."""
    parts = people.select(F.explode(F.array(*[F.col(c).cast("string") for c in columns])).alias("w")).select(F.explode(F.split("w", "[ -]+")).alias("w"))

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([fold_name(w) for w in batch.column(0).to_pylist()], pa.string())], names=["w"])

    return parts.where("length(w) > 2").distinct().mapInArrow(fold, "w string").distinct()


def _hashes(words: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter({name_hash(p) for w in batch.column(0).to_pylist() if w for p in re.split(r"[^\w]+", w) if len(p) > 2}, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["h"])

    return words.mapInArrow(run, "h bigint").distinct()


def gazetteer(people: DataFrame, *columns: str, texts: DataFrame | None = None, most: int = SENT_NAMES) -> np.ndarray:
    """Hashes of all parts of the names in ``columns``, sorted; beyond ``most`` of those that occur in the one column of
    ``texts``, by a join with its distinct words. More than that raises an error rather than losing names."""
    names = _hashes(_parts(people, columns))
    if texts is not None and names.count() > most:

        def folded_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([fold_name(cleaned(t)) for t in batch.column(0).to_pylist() if t], pa.string())], names=["t"])

        names = names.join(_hashes(texts.select(F.col(texts.columns[0]).cast("string").alias("t")).mapInArrow(folded_words, "t string")), "h", "left_semi")
    found = names.limit(most + 1).toArrow().column(0).to_numpy()
    if len(found) > most:
        raise ValueError(f"more than {most} names occur in the texts: raise SENT_NAMES and the workers' memory")
    return np.sort(found.view(np.uint64))


def endings(people: DataFrame, *columns: str) -> frozenset[str]:
    """The last letters that ``ENDING_NAMES`` different names at least have: at most as many as there are such letters."""
    ends = _parts(people, columns).where(F.length("w") > ENDING_LETTERS + 1).select(F.expr(f"right(w, {ENDING_LETTERS})").alias("e"))
    return frozenset(r.e for r in ends.where("e rlike '^[a-z]+$'").groupBy("e").count().where(F.col("count") >= ENDING_NAMES).collect())


_scanners: dict[str, Scanner] = {}  #: of a worker: what it knows of tokens serves all its tasks


def held_key(held) -> str:
    """A name for a broadcast value: its number in the application."""
    return str(held._jbroadcast.id())


def scanner_of(key: str, held) -> Scanner:
    if key not in _scanners:
        _scanners.clear()
        _scanners[key] = Scanner(*held.value)
    return _scanners[key]


_CANDIDATES = "tabelle string, schluessel string, art string, votes int, start int, end int"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 6
    types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["tabelle", "schluessel", "art", "votes", "start", "end"])


def text_candidates(rows: DataFrame, name: str, key: str, text: str, held) -> DataFrame:
    """Candidates in a text column: one row a span, offsets in the cleaned text."""

    key_of = held_key(held)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_of(key_of, held)
        for batch in batches:
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for a, b, kind, votes in scanner.spans(cleaned(t)):
                    out.append((name, k, kind, votes, a, b))
            yield _batch(out)

    picked = rows.select(F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("t")).where("t is not null and t <> ''")
    return picked.mapInArrow(scan, _CANDIDATES)


def word_candidates(words: DataFrame, name: str, held, *, key: str, document: str, reading: str, order: str, page: str, top: str, text: str) -> DataFrame:
    """Candidates in words of receipts: one row a word under a span.

    Words of one reading of a receipt are ordered by ``order`` and read in blocks of ``BLOCK`` with ``LAP`` words
    of either neighbour, so no group grows with the data; lines break where ``top`` or ``page`` changes.
    """
    at = F.coalesce(F.col(order).cast("bigint"), F.pmod(F.xxhash64(key), F.lit(1 << 40)))
    own = F.floor(at / BLOCK)
    inside = F.pmod(at, F.lit(BLOCK))
    blocks = F.when((inside < LAP) & (own > 0), F.array(own, own - 1)).when(inside >= BLOCK - LAP, F.array(own, own + 1)).otherwise(F.array(own))
    line = F.struct(
        at.alias("o"),
        F.col(key).cast("string").alias("k"),
        F.xxhash64(F.col(page), F.col(top)).alias("l"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"),
        own.alias("own"),
    )
    spread = words.select(F.col(document).alias("d"), F.col(reading).alias("r"), F.explode(blocks).alias("block"), line.alias("w"))
    grouped = spread.groupBy("d", "r", "block").agg(F.sort_array(F.collect_list("w")).alias("w"))
    flat = grouped.select("block", F.col("w.k").alias("k"), F.col("w.l").alias("l"), F.col("w.t").alias("t"), F.col("w.own").alias("own"))

    key_of = held_key(held)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = scanner_of(key_of, held)
        for batch in batches:
            out = []
            ends = batch.column(1).offsets.to_pylist()
            keys, lines, texts, owns = (batch.column(c).flatten().to_pylist() for c in (1, 2, 3, 4))
            base = ends[0]
            for g, block in enumerate(batch.column(0).to_pylist()):
                lo, hi = ends[g] - base, ends[g + 1] - base
                starts, parts, at = [], [], 0
                for i in range(lo, hi):
                    if parts:
                        sep = " " if lines[i] == lines[i - 1] else "\n"
                        parts.append(sep)
                        at += 1
                    word = cleaned(texts[i]).strip()
                    starts.append(at)
                    parts.append(word)
                    at += len(word)
                starts.append(at + 1)
                for a, b, kind, votes in scanner.spans("".join(parts)):
                    for i in range(hi - lo):
                        if starts[i] >= b:
                            break
                        if starts[i + 1] - 1 > a and owns[lo + i] == block:
                            out.append((name, keys[lo + i], kind, votes, a, b))
            yield _batch(out)

    return flat.mapInArrow(scan, _CANDIDATES)


def decisions(candidates: DataFrame) -> DataFrame:
    """(art, votes, p): the classifier's probability of each vote pattern of each kind, from counts over all rows."""
    counted: dict[str, list[tuple[int, int]]] = {}
    for r in candidates.groupBy("art", "votes").count().collect():  # bounded by the number of labelers and features
        counted.setdefault(r.art, []).append((r.votes, r["count"]))
    rows = []
    for kind, seen in sorted(counted.items()):
        seen.sort()
        sign = [{"-": -1, "+": 2}.get(x[0], 1) for x in LABELERS[kind]] + [0] * len(FEATURES)
        rows += [(kind, v, float(p)) for v, p in decide([v for v, _ in seen], [n for _, n in seen], sign).items()]
    return candidates.sparkSession.createDataFrame(rows, "art string, votes int, p double")


def accepted(candidates: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The candidates that the trained classifier takes for personal data."""
    return candidates.join(F.broadcast(decisions(candidates)), ["art", "votes"]).where(F.col("p") >= threshold)


def redacted(rows: DataFrame, found: DataFrame, name: str, key: str, text: str, out: str = "redigiert") -> DataFrame:
    """The rows of table ``name`` of which ``text`` holds personal data, with placeholders in its place in ``out``.

    ``found`` are accepted candidates with offsets in the cleaned text; overlapping spans become one placeholder,
    that of the longer span. Rows without personal data are left out: their text stays as it is.
    """
    spans = found.where(F.col("tabelle") == name).groupBy("schluessel").agg(F.collect_set(F.struct("start", "end", "art")).alias("_spans"))
    joined = rows.select(F.col(key).cast("string").alias("schluessel"), F.col(text).cast("string").alias("_text")).join(spans, "schluessel")

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [replaced(cleaned(t or ""), [(s["start"], s["end"], s["art"]) for s in spans]) for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["schluessel", out])

    return joined.mapInArrow(put, f"schluessel string, `{out}` string")


def replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with a typed placeholder for each span; the rest is unchanged."""
    out, at = [], 0
    for start, end, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start < at:
            continue
        out += [text[at:start], PLACEHOLDERS[kind]]
        at = end
    return "".join(out) + text[at:]
