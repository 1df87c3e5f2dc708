"""Names of issuers as people type them: their parts, edit distances and deletion neighbourhoods."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from itertools import permutations

from ledgerloom.llm.chars import _FOLD_LOOKS, bare

_UMLAUTS = str.maketrans({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l"})


def fold_name(text: str) -> str:
    """Without case and accents, umlauts written out, look-alike letters Latin."""
    t = text.lower()
    if not t.isascii():
        t = unicodedata.normalize("NFC", bare(text).casefold().translate(_FOLD_LOOKS)).translate(_UMLAUTS)
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    return t


def collapse(word: str) -> str:
    """A folded word with umlauts as one letter: a slip in one is then a single edit too."""
    return word.replace("ae", "ä").replace("oe", "ö").replace("ue", "ü")


# Words for a line of business that are known without a corpus; ``variants.learned_lines`` adds those it has.
TRADES = (
    "treuhand kindertagesstaette maschinenfabrik sparkasse bauunternehmung logistik transporte versicherung immobilien "
    "hilfswerk privatbank schreinerei weiterbildung malergeschaeft krankenkasse elektrotechnik vorsorge "
    "genossenschaftsbank apotheke pharma kantonalbank stiftung gartenbau sanitaer werke raiffeisenbank regionalbank "
    "hypothekarbank baeckerei metzgerei garage druckerei verlag hotel restaurant klinik spital praxis architektur "
    "ingenieure informatik reisen optik drogerie spenglerei zimmerei bedachungen pensionskasse ausgleichskasse "
    "kinderkrippe fahrschule sprachschule reinigung gastronomie energie handel"
).split()
SHORT_TRADES = {"kk": "krankenkasse", "kita": "kindertagesstaette", "kb": "kantonalbank", "pk": "pensionskasse"}
# Legal forms and titles.
LEGAL = {"ag", "sa", "gmbh", "sarl", "genossenschaft", "gen", "co", "cie", "aktiengesellschaft", "verein", "kg", "ltd", "inc", "srl", "spa", "llc", "kollektivgesellschaft", "einzelfirma"}
TITLES = {"dr", "med", "dent", "vet", "phil", "lic", "iur", "oec", "prof", "dipl", "ing", "rer", "pol", "pharm", "nat", "mag", "msc", "bsc", "mba", "eth", "fmh", "herr", "frau", "hr", "fr", "herrn", "mme", "madame", "monsieur", "signor", "signora", "sig", "familie"}
#: Endings of Swiss place names; such a word after a name is a place.
_SURE_PLACE = re.compile(r"(ikon|wil|bueel|dorf|hofen|lingen|matt|stetten)$")
# Short forms of given names and the names they stand for, folded.
_SHORT = {
    "alexander": "alex sandro xandi lexi", "andreas": "res andi andy endi resli", "annesophie": "sophie anni anne annso", "antoinette": "toni nettli nette toinette", "benedikt": "beni bene benni dikt",
    "bernadette": "berni detti dette bernie", "christoph": "chrigu christof stoffel chris chrigel stoeffu", "dorothea|theodora": "thea dora", "dorothea": "doris dorli dorthe", "dragana": "draga gana", "elisabeth": "lisbeth elsbeth betli lisi beth sisi liseli bethli lisa elsa",
    "etienne": "tienne eti stephan", "flurin": "flu fluri rin", "franziska": "fraenzi franzi ziska fraeni", "friedrich": "fritz fridli friedel fredi fritzli", "genevieve": "gene vieve ginette viv", "gianluca": "luca gian gigi", "giuseppina": "giusi pina peppina beppina", "jakob": "koebi jack joggi jaggi",
    "johannes": "hannes hans joh haensel hansli", "katharina": "kathrin kathi kaethi trini katja kaetheli rina", "ladina": "dina ladi", "leonhard": "leo lienhard hardy leni", "luis": "lu lui", "magdalena": "magda lena leni madlen", "margrit": "gritli greti margrith margret maegi grit",
    "matthias": "maetthu mathias hias thias matze maettu", "maximilian": "max maxi mex", "noemie": "noemi mie emi nono", "raffaele": "raffi lele raf", "regula": "regi regeli regle regu", "rosmarie": "roesli rosi rosmari roesi marie", "sebastian": "basti sebi bastian seb", "silvan": "silvi silu silvano",
    "susanne": "susi sanne susann susanna suse", "theodora": "theo dora", "ulrich": "ueli uli ulli", "ursula": "ursi uschi urseli ursel ursle", "verena": "vreni vre vreneli vere", "yannick": "yann yanni nick", "zeynep": "zeyno zey zeyni", "rudolf": "ruedi rudi", "josef": "sepp seppi", "peter": "pesche peterli", "heinrich": "heiri heini", "walter": "waelti walti",
    "barbara": "babs baerbel", "margaretha": "gretli grethe", "maria": "mia mizzi", "anna": "aenni anneli", "werner": "werni", "ernst": "aschi", "daniel": "daenu dani", "thomas": "tom toemu", "michael": "michi mike", "markus": "kusi max", "stefan": "steff stefu", "martin": "tinu martl",
}
NICKNAMES: dict[str, set[str]] = {}
for _full, _shorts in _SHORT.items():
    for _one in _shorts.split():
        NICKNAMES.setdefault(_one, set()).update(_full.split("|"))

GIVEN = set(NICKNAMES) | {f for full in NICKNAMES.values() for f in full}
LONG = 9  #: letters from which a word may have two slips that do not change its sound

_FORMS = (
    (re.compile(r"(?:&|\b(?:u|und|et)\b\.?) ?(?:co|cie)\b\.?"), " co "),
    (re.compile(r"\bg\. ?m\. ?b\. ?h\b\.?"), " gmbh "),
    (re.compile(r"(?<![a-z])a\. ?g\b\.?"), " ag "),
    (re.compile(r"(?<![a-z])s\. ?a\b\.?"), " sa "),
    (re.compile(r"gen(?:oss)?\. ?bank\b"), " genossenschaftsbank "),
    (re.compile(r"\bs\. ?a ?r\. ?l\b\.?"), " sarl "),
)
_SAINT = re.compile(r"\b(?:sankt|skt|st)\b\.?[ -]*(?=[a-z])")
_LEGAL_FORM = {"aktiengesellschaft": "ag", "genossenschaft": "gen", "cie": "co"}
_TOKEN = re.compile(r"[a-z0-9]+(?:['][a-z0-9]+)*\.?|&")
_POSTCODE = re.compile(r"\b(?:ch|a|d|f|i|fl)?[- ]?\d{4,5}\b")


def distance(a: str, b: str, most: int = 2) -> int:
    """Damerau-Levenshtein distance (adjacent transpositions count one), ``most + 1`` beyond ``most``."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


_KEYS = {a: set(b) for row in ("qwertzuiop", "asdfghjkl", "yxcvbnm") for i, a in enumerate(row) for b in [row[max(0, i - 1) : i + 2]]}


def weighted(a: str, b: str) -> float:
    """Damerau-Levenshtein distance in which slips that typing makes often cost less than one."""
    x, y = collapse(a), collapse(b)
    return min(_weighted(a, b), _weighted(x, y)) if (x, y) != (a, b) else _weighted(a, b)


def _weighted(a: str, b: str) -> float:
    rows = [[j * 1.0 for j in range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row = [i * 1.0]
        for j, y in enumerate(b, 1):
            same = 0.0 if x == y else (0.7 if y in _KEYS.get(x, ()) else 1.0)
            drop = 0.6 if i > 1 and a[i - 2] == x else 1.0
            add = 0.6 if j > 1 and b[j - 2] == y else 1.0
            cost = min(rows[i - 1][j] + drop, row[-1] + add, rows[i - 1][j - 1] + same)
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, rows[i - 2][j - 2] + 0.8)
            row.append(cost)
        rows.append(row)
    return rows[-1][-1]


def deletions(word: str, most: int = 1) -> set[str]:
    """The word and what is left of it after up to ``most`` deletions: two words within that many edits share one."""
    out = layer = {word}
    for _ in range(most):
        layer = {w[:i] + w[i + 1 :] for w in layer for i in range(len(w))}
        out = out | layer
    return out


def apart(a: str, b: str, most: int = 1) -> int:
    """Edits between folded words, an umlaut counting as one letter or as two, whichever needs fewer."""
    d = distance(a, b, most)
    if d > 1 or d > most:
        x, y = collapse(a), collapse(b)
        if x != a or y != b:
            return min(d, distance(x, y, most))
    return d


def keys(word: str, most: int = 1) -> set[str]:
    """What two words within ``most`` edits, as ``apart`` counts them, have in common."""
    c = collapse(word)
    return deletions(word, most) if c == word else deletions(word, most) | deletions(c, most)


class Deletes:
    """Symmetric-delete dictionary of a bounded word list."""

    def __init__(self, words, most: int = 1):
        self.most = most
        self.index: dict[str, list[str]] = {}
        for w in sorted(set(words)):
            for d in keys(w, most):
                self.index.setdefault(d, []).append(w)

    def near(self, word: str, most: int | None = None) -> list[tuple[int, str]]:
        """(distance, entry) of the entries within ``most`` edits, nearest first."""
        most = self.most if most is None else most
        seen = {w for d in keys(word, most) for w in self.index.get(d, ())}
        return sorted((d, w) for w in seen if (d := apart(word, w, most)) <= most)


_legal_long = Deletes([w for w in LEGAL if len(w) > 7])


def _in_order(short: str, long: str) -> bool:
    at = iter(long)
    return all(c in at for c in short)


class Lines:
    """Words for lines of business, and what tokens mean by them."""

    def __init__(self, words):
        self.words = tuple(dict.fromkeys(words))
        self.set = set(self.words)
        self.deletes = Deletes(self.words)
        self.by_length = sorted(self.words, key=lambda w: (-len(w), w))
        self.of: dict[tuple[str, bool], tuple[str, int] | None] = {}
        self.ends: dict[tuple[str, bool], tuple[str, str, int] | None] = {}

    def trade_of(self, token: str, dotted: bool) -> tuple[str, int] | None:
        """(line of business, edits) a token names: whole, abbreviated or with one slip."""
        return _remembered(self.of, (token, dotted), self._trade_of)

    def glued_trade(self, token: str, dotted: bool = False) -> tuple[str, str, int] | None:
        """(rest, line of business, edits) of a token that ends in one; after a dot also in an abbreviation of one."""
        return _remembered(self.ends, (token, dotted), self._glued_trade)

    def _trade_of(self, token: str, dotted: bool) -> tuple[str, int] | None:
        if token in SHORT_TRADES:
            return SHORT_TRADES[token], 0
        if token in self.set:
            return token, 0
        if dotted and len(token) > 1:
            for test in (lambda w: w.startswith(token), lambda w: w[0] == token[0] and (len(token) > 2 or w[1] not in "aeiou" or token[1] in w[1:]) and _in_order(token, w)):
                if hits := [w for w in self.words if len(w) > len(token) and test(w)]:
                    return hits[0], 0
        if len(token) > 4:
            if near := self.deletes.near(token):
                return near[0][1], near[0][0]
        if dotted and len(token) > 3:  # an abbreviation with a slip
            for w in self.words:
                if len(w) > len(token) + 1 and distance(token, w[: len(token)], 1) == 1:
                    return w, 1
        return None

    def _glued_trade(self, token: str, dotted: bool) -> tuple[str, str, int] | None:
        if dotted:
            for size in range(min(12, len(token) - 5), 1, -1):
                rest, end = token[:-size], token[-size:]
                if (got := SHORT_TRADES.get(end)) or (got := next((w for w in self.words if len(w) > size and w.startswith(end)), None)):
                    if size > 2 or rest[-1] not in "aeiou":
                        return rest, got, 0
        for w in self.by_length:
            if token.endswith(w) and len(token) - len(w) > 3:
                return token[: -len(w)], w, 0
        for w in self.by_length:
            if len(w) > 5:
                for size in (len(w), len(w) - 1, len(w) + 1, len(w) - 2, len(w) + 2):
                    rest, end = token[:-size], token[-size:]
                    if len(rest) > 3 and end[0] == w[0] and apart(end, w, 1) == 1:
                        return rest, w, 1
        for short, w in SHORT_TRADES.items():
            if token.endswith(short) and len(token) - len(short) > 4:
                return token[: -len(short)], w, 0
        return None


def _remembered(held: dict, key: tuple, of):
    if key not in held:
        if len(held) > 200_000:
            held.clear()
        held[key] = of(*key)
    return held[key]


KNOWN = Lines(TRADES)
trade_of, glued_trade = KNOWN.trade_of, KNOWN.glued_trade


def short_for(short: str, full: str) -> bool:
    """Whether one given name is a short form of another: by the list, or its beginning, end or stem."""
    if len(short) >= len(full) + 1 or short == full or len(short) < 2:
        return False
    stem = 0
    while stem < min(len(short), len(full)) and short[stem] == full[stem]:
        stem += 1
    return full in NICKNAMES.get(short, ()) or full.startswith(short) or (len(short) > 2 and full.endswith(short)) or (stem > 2 and len(short) < 7 and len(short) < len(full))


@dataclass
class Name:
    """The parts of a name: kind is org, person, acronym or ''; legal form, a Sankt before the name and a place, where given."""

    kind: str = ""
    words: list[str] = field(default_factory=list)
    trade: str = ""
    legal: str = ""
    saint: bool = False
    place: str = ""


def parse(text: str | None, lines: Lines = KNOWN) -> Name:
    """Parts of an issuer name as typed; '' as kind for blank text or one without a name."""
    trade_of, glued_trade = lines.trade_of, lines.glued_trade
    if not text or not text.strip():
        return Name()
    s = fold_name(text)
    for pattern, by in _FORMS:
        s = pattern.sub(by, s)
    s, saints = _SAINT.subn(" ", s)
    segments = [p for p in s.split(",") if p.strip()]
    words: list[tuple[str, bool]] = []  # word, whether a dot followed
    trade, titled, legal, place = "", False, "", ""
    for n, segment in enumerate(segments):
        if n and (code := _POSTCODE.search(segment)):
            place = "".join(_TOKEN.findall(segment[code.end() :])[:1]) or place
            segment = segment[: code.start()]
        else:
            segment = _POSTCODE.sub(" ", segment)
        for part in re.split(r"[ /]+", segment.strip()):
            tokens = _TOKEN.findall(part.replace("-", " "))
            if "-" in part and len(tokens) > 1 and not any(trade_of(t.rstrip("."), t.endswith(".")) for t in tokens):
                tokens = ["".join(t.rstrip(".") for t in tokens)]  # a double name
            for raw in tokens:
                word, dotted = raw.rstrip("."), raw.endswith(".")
                if word in TITLES and (dotted or len(word) > 2):
                    titled = True
                elif word in LEGAL or (len(word) > 7 and _legal_long.near(word) and not trade_of(word, False)):
                    form = word if word in LEGAL else _legal_long.near(word)[0][1]
                    legal = legal or _LEGAL_FORM.get(form, form)
                elif not trade and (got := trade_of(word, dotted)):
                    trade = got[0]
                elif n and _SURE_PLACE.search(word):
                    place = word
                elif word.isdigit() or word in {"&", "und", "et"}:
                    continue
                else:
                    words.append((word, dotted))
    if not words:
        return Name()
    if trade or legal:
        if not trade:
            for i, (w, dotted) in enumerate(words):
                if got := glued_trade(w, dotted):
                    words[i], trade = (got[0], False), got[1]
                    break
        kept = [words[0][0]] + [w for w, _ in words[1:] if not _SURE_PLACE.search(w)]
        place = place or next((w for w, _ in words[1:] if _SURE_PLACE.search(w)), "")
        return Name("org", kept, trade, legal, saints > 0, place)
    if len(words) == 1:
        word, dotted = words[0]
        if got := glued_trade(word, dotted):
            return Name("org", [got[0]], got[1])
        if titled:
            return Name("person", [word])
        return Name("acronym" if re.fullmatch(r"[A-Z]{3,6}", bare(text).strip()) else "org", [word])
    for i, (w, dotted) in enumerate(words):
        if not titled and (got := glued_trade(w, dotted)):
            rest = [x for j, (x, _) in enumerate(words) if j != i and not _SURE_PLACE.search(x)]
            return Name("org", [got[0], *rest], got[1])
    return Name("person", [w for w, _ in words])


def business_words(text: str) -> list[str]:
    """The undotted words of a name with a legal form, without that form, titles and places; none of other names."""
    s = fold_name(text)
    for pattern, by in _FORMS:
        s = pattern.sub(by, s)
    tokens = _TOKEN.findall(_SAINT.sub(" ", s).split(",")[0].replace("-", " "))
    if not any(t.rstrip(".") in LEGAL for t in tokens):
        return []
    return [t for t in tokens if len(t) > 3 and t.isalpha() and t not in LEGAL and t not in TITLES and not _SURE_PLACE.search(t)]


def initials(name: Name) -> str:
    """The letters an acronym of the organisation has; a compound ending in -bank or -kasse gives two."""
    t = name.trade
    tail = next((t[0] + e[0] for e in ("bank", "kasse", "versicherung", "werk", "fabrik") if t.endswith(e) and t != e), t[:1])
    return "".join(w[0] for w in name.words) + tail


_SOUNDS = ((re.compile(r"(?<=[aeiouy])h"), ""), (re.compile("th"), "t"), (re.compile("ph|v"), "f"), (re.compile("ck|c(?=[^eih])"), "k"), (re.compile("y"), "i"), (re.compile("tz"), "z"), (re.compile(r"(.)\1+"), r"\1"))


def sound(word: str) -> str:
    """A folded word without what is written but not heard: doubled letters, a silent h, letters of one sound."""
    w = collapse(word)
    for pattern, by in _SOUNDS:
        w = pattern.sub(by, w)
    return w


def pair_cost(a: str, b: str) -> float | None:
    """What it costs to take one word for the other: equal 0, a slip 1, an initial or abbreviation a half."""
    if a == b:
        return 0.0
    short, long = sorted((a, b), key=len)
    if len(short) == 1:
        return 0.5 if long[0] == short else None
    if len(short) == 2 and len(long) > 6 and long[0] == short[0] and any(long[i] == short[1] and long[i:] in GIVEN for i in range(3, len(long) - 2)):
        return 0.5  # the initials of a double name
    if long == short + "er":
        return 0.5
    if len(short) >= 4 and apart(a, b, 1) == 1:
        return 1.0
    if len(short) >= LONG and sound(a) == sound(b) and apart(a, b, 2) == 2:
        return 2.0
    return None


def align(a: list[str], b: list[str], most: float = 1.5) -> float | None:
    """Cost of the best assignment of all words of one name to those of the other, or None if there is none."""
    if len(a) != len(b) or len(a) > 6:
        return None if a != b else 0.0
    best = None
    for order in permutations(b):
        total = 0.0
        for x, y in zip(a, order):
            cost = pair_cost(x, y)
            if cost is None:
                break
            total += cost
        else:
            if total <= most and (best is None or total < best):
                best = total
    return best
