"""Scores of abusive, hateful and sexually explicit content by a weighted finite-state grammar.

A lexicon transducer maps each word, however it is disguised, to classes: insults, violence, groups of people,
demeaning words, sexual words, targets, speakers, negation, reported speech, professional contexts. A people is known
by its form, not by a list: a capitalised noun with the ending of a people's name, where a clause speaks of it in
general. Pattern transducers over the classes, with bounded gaps, are composed with the lexicon; the heaviest path
through a clause chain gives the score of a sentence. Isolated words score little: a pattern needs a target, a group
or a speaker. Negation, reported speech and professional contexts take weight from the paths they surround, not from
others of the sentence. The weights start from those below and are fitted to judged examples (``fitted``).
"""

from __future__ import annotations

import math
import operator
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.chars import bare, folded, free_name

# The lexicon, folded, by class; * stands for any ending.
WORDS = {
    "INSULT": "arschloch arschgeige arschgesicht hornochse hornochsen idiot idioten idiotin vollidiot vollidioten volltrottel schwachkopf schwachkoepfe mistkerl mistkerle drecksack drecksau drecksschwein dreckskerl trottel saftsack saftsaecke pissnelke vollpfosten wichser hurensohn fotze schlampe nutte missgeburt spast spasti vollspast depp volldepp bloedmann dummkopf hohlkopf schweinehund dreckstueck miststueck scheisskerl arschkriecher pisser penner hackfresse flachzange bloedian armleuchter schafskopf schwachmat rindvieh vollhonk "
    "asshole assholes bastard bastards scumbag moron morons moronic motherfucker dickhead wanker cunt bitch whore slut douchebag jackass dumbass shithead idiots imbecile arsehole twat halfwit "
    "cretin cretins cretine abruti abrutis abrutie salaud salauds salope connard connards connasse imbeciles encule enculee batard ordure enfoire enfoires fdp pute debile crevard bouffon trouduc "
    "stronzo stronza stronzi idiota idioti cretino cretina cretini imbecille imbecilli coglione coglioni bastardo bastardi puttana troia merdoso deficiente",
    "WEAKINSULT": "null affe affen schwein schweine sau saeue ochse esel dreck stueck dumm strohdumm doof bloed haesslich hirnlos hirnlose hirnloser verlogen verlogene widerlich abschaum luder pack ratte ratten wertlos wertloses wertloser wertlose "
    "korrupt korrupte korruptes korrupter scheisse nichtsnutz versager worthless ugly stupid pathetic corrupt waste shit dumb brainless trash garbage pig pigs rat rats filthy loser scum piece porc porcs merde con cons nul nulle laid "
    "moche stupide sale bande vermine minable stupido stupida schifoso schifosa merda porco porci maiale maiali",
    "COMMAND": "friss verpiss sonstwohin vaffanculo",
    "VIOLENT": "verpruegel* verreckst verrecken verreck krepier* umbringen abstechen erschiess* erwuerg* aufhaengen egorger creves crepi crepa crepiate crepino crevez ammazzo ammazzarti",
    "WISH": "hoffentlich",
    "GROUP": "auslaender* fluechtling* asylant* migrant* zigeuner* juden muslim* moslem* neger* kanake* tuerken albaner* jugos serben araber* afrikaner* schwuchtel* schwule* transe* behindert* foreigner* immigrant* jews muslims blacks gypsies "
    "gays etranger etrangers immigres arabes juifs musulmans gitans stranieri immigrati ebrei musulmani negri zingari froci",
    "DEMEAN": "ungeziefer seuche abschaum untermensch* parasit* schmarotzer* pack gesindel drecksvolk dreckspack viecher dreck kriminell* verbrecher* diebe faul verlogen ratten plage krebsgeschwuer pestbeule minderwertig* primitiv* vermin "
    "subhuman scum thieves filthy animals animal criminals rats plague cockroach* savages lazy vermine pourriture voleurs race animaux ordures crasse racaille fleau sales parassiti feccia ladri animali sporchi bestie criminali "
    "spazzatura",
    "EXPEL": "ausgerottet ausrotten ausgeschafft ausschaffen weggesperrt wegsperren vergast vergasen davonjagen verjagen abgeschoben drown drowned exterminated gassed hanged exterminer chasser cacciati cacciare rinchiusi sterminati affogati",
    "SEX": "ficken fick fickst gefickt voegeln voegle gevoegelt titten moese muschi schwanzlutsch* nacktfoto* nacktbild* flachlegen flachgelegt vernaschen bumsen orgasmus fuck fucking fucked nudes blowjob handjob horny baiser nichons bander "
    "sucer sodom* branle* scopare scopata tette cazzo pompino sborr*",
    "SEXWEAK": "nackt nackte schwanz brueste busen arsch geil geile geiles hoeschen lecken lecke sexy strip naked nue seins culo nuda sesso pussy cock tits titties",
    "YOU": "du dich dir dein deine deinen deinem deiner deines ihr euch euer eure euren eurem sie ihnen ihre ihren ihrem you your yours yourself tu te toi ton ta tes vous votre vos t ti tuo tua tuoi lei voi vi vostro vostra sei siete",
    "ESSENCE": "",
    "I": "ich mich mir wir uns i me my we je j me moi mon nous io mi mio voglio vorrei mandami dammi",
    "DEMEANVERB": "stinken stinkt klauen klaut betruegen betruegt stink stinks steal cheat puent volent mentent puzzano rubano mentono",
    "PACK": "pack gesindel drecksvolk dreckspack viecher abschaum scum vermin vermine racaille pourriture feccia bestie",
    "OUT": "raus hinaus dehors fuori vertrieben deported",
    "HANG": "strick galgen genickschuss kugel gas noose gallows corde forca",
    "WATER": "fluss see teich moor brunnen river lake fiume lago riviere",
    "DEEP": "tief deep profond profonde profondo",
    "MUST": "gehoeren gehoert soll sollen sollte sollten muss muessen should must ought faut vanno devono bisogna on",
    "ANY": "die den diese diesen dieser solche solchen alle einem einen ein kein keinem jeder jedem these those every no all any the les ces tous un aucun i gli questi quei tutti un ogni nessun",
    "TYPICAL": "typisch typical typique tipico",
    "DOWITH": "",
    "WHOEVER": "wer whoever qui chi solange",
    "SEND": "send schickt schick renvoyez rimandate kick",
    "BACK": "back zurueck retour indietro",
    "THEY": "they sie ils elles loro leute people gens gente volk denen",
    "SEXYOU": "scoparti succhiarmelo succhiami leccarti",
    "VOCATIVE": "",
    "PEOPLE": "",
    "WHO": "welcher welche solche solcher dieser diese quel quelle quels whoever which these ces questi typisch solange",
    "PERSON": "tante frau mann typ kerl dame weib tussi alte alter chef chefin mitarbeiter mitarbeiterin beamter beamte sachbearbeiter sachbearbeiterin lady guy woman man clerk idiotin femme type bonhomme mec dame signora tizio tipo donna uomo",
    "BE": "seid sind bist are etes es sei siete sont sono reste restent bleiben bleibt remain remains is war waren were",
    "BEAST": "affe affen schwein schweine sau saeue ratte ratten esel ochse ochsen hund hunde parasiten ungeziefer abschaum pack pig pigs rat rats dog dogs scum vermin porc porcs chien chiens maiale maiali porco porci ratti bestie",
    "NOT": "nicht kein keine keinen keiner not never isn no pas jamais non mai nessun",
    "REPORT": "beschimpft beschimpfung beschimpfungen bedroht bedrohung beleidigt beleidigung beleidigungen gemeldet protokolliert angezeigt strafanzeige opfer erkennen praevention vorfall nannte sagte zitat reported complaint insulted threatened victim victims awareness recognise recognize prevention quoted signale insulte insultes menaces victime victimes plainte haine segnalato insultato minacciato vittima vittime denuncia odio",
    "NEUTRAL": "kurs cours corso beratung schaedlingsbekaempfung kammerjaeger derattizzazione tierarzt veterinaire veterinary veterinario kastration sterilisation screening gynaekologie ginecologica gynecologie urologie sexologie sexologist "
    "sexology therapie konsultation consultation visita lesung theater ausstellung museum medizin medizinisch* verhuetung schwangerschaft education aufklaerung desinfestazione deratisation labor",
}
PHRASES = {
    "INSULT": "pezzo di merda|testa di cazzo|figlio di puttana|piece of shit|sack of shit|fils de pute|stueck dreck|stueck scheisse|waste of space",
    "COMMAND": "verpissen sie|halt die fresse|haltet die fresse|halt endlich die fresse|halt die klappe|halt dein maul|halt endlich dein maul|haltet das maul|haltet endlich das maul|halt das maul|halt s maul|leck mich|leckt mich|fick dich|fickt euch|sonst wohin|scher dich zum teufel|geh zum teufel|fahr zur hoelle|"
    "go to hell|fuck you|fuck off|piss off|screw you|shut the fuck up|shut your mouth|shut your trap|kiss my ass|drop dead|up your ass|"
    "te faire foutre|vous faire foutre|te faire voir|ta gueule|ferme la|fermez la|nique ta mere|va crever|casse toi|farti fottere|a cagare|vai al diavolo|va al diavolo|all inferno|chiudi il becco|chiudi la bocca|chiudi quella bocca|chiudi la tua bocca",
    "VIOLENT": "schlag dir|schlage dir|schlag ihnen|schlage ihnen|schlag euch|zaehne ein|fresse ein|zuende euch|zuende dir|zuende ihnen|bude an|buero an|pruegle dich|pruegle euch|pruegle sie|ueber den haufen|bringe dich um|bring dich um|bringe euch um|bring euch um|stech dich ab|steche dich ab|mach dich kalt|mache dich kalt|knall dich ab|knalle dich ab|brech dir|breche dir|brich dir|toete dich|mach dich fertig|mache dich fertig|wo du wohnst|"
    "break your neck|break your legs|break your face|break your fingers|kick your teeth|kick your head|smash your face|smash your head|smash your teeth|beat you|kill you|shoot you|stab you|burn your|burn down|choke on|slit your|cut your throat|hunt you down|where you live|rip your|you dead|hang you|"
    "casser la figure|casser la gueule|te casser|tu creves|te tuer|vous tuer|te buter|te demolir|la peau|peter la gueule|le feu|des claques|"
    "spacco la faccia|spacco le ossa|ti spacco|ti ammazzo|ti uccido|ti brucio|devi morire|ti spezzo|ti faccio fuori|darti fuoco",
    "WISH": "i hope|j espere|spero che|wuensche dir|wuensche euch|wish you",
    "WHO": "so ein|so eine|was fuer ein|bande de|what a|che razza|razza di",
    "EXPEL": "an die wand|wiped out|locked up|be gassed|be shot|be hanged|drown them|les chasse|les enferme|a la mer",
    "OUT": "get out|thrown out|fuori i",
    "ESSENCE": "im blut|in their blood|dans le sang|nel sangue|nel loro sangue|sale race",
    "GROUP": "you people|people from|people like|leute aus|leute wie|gens de|gente di",
    "DOWITH": "man mit|wir mit|did with|do with|done with|fait avec|faisait avec|si fa con|si faceva con",
    "THEY": "quella gente|ces gens|those people|diese leute",
    "WEAKINSULT": "null hirn|kein hirn|no brain|scheisse im kopf|pas de cerveau",
    "SEX": "ohne hoeschen|geiles luder|geile sau|zieh dich aus|zieh dich nackt aus|nude pics|naked pics|get so hard|photos nue|photo nue|foto nuda|foto nude",
    "SEXYOU": "besorg es dir|besorge es dir|lecke ich dich|leck ich dich|lecke dich|mein schwanz|meinen schwanz|suck me|suck my|sucking me|cum on|spread your legs|jerk off|ride me|je bande|me sucer|suce moi|ecarte les jambes|apri le gambe",
    "NEUTRAL": "pest control",
}

# The patterns: classes in order, ~n for a gap of up to n words, and the weight of the whole.
PATTERNS = (
    ("insult", "INSULT", 0.75),
    ("insult", "YOU ~6 INSULT", 1.2),
    ("insult", "INSULT ~6 YOU", 1.1),
    ("insult", "WHO ~8 INSULT", 1.1),
    ("insult", "WEAKINSULT ~1 INSULT", 1.1),
    ("insult", "WHO ~5 WEAKINSULT ~2 WEAKINSULT", 1.0),
    ("insult", "YOU ~3 WEAKINSULT", 0.7),
    ("insult", "YOU ~4 WEAKINSULT ~2 WEAKINSULT", 1.1),
    ("insult", "WEAKINSULT ~3 WEAKINSULT", 0.8),
    ("insult", "PERSON ~5 WEAKINSULT ~3 WEAKINSULT", 1.0),
    ("insult", "WEAKINSULT ~9 YOU ~2 WEAKINSULT", 1.2),
    ("insult", "WEAKINSULT ~4 YOU", 0.6),
    ("insult", "YOU ~1 BE ~5 BEAST", 1.1),
    ("insult", "COMMAND", 1.1),
    ("threat", "VIOLENT", 0.8),
    ("threat", "VIOLENT ~4 VIOLENT", 1.1),
    ("threat", "I ~4 VIOLENT", 1.2),
    ("threat", "VIOLENT ~4 YOU", 1.1),
    ("threat", "YOU ~6 VIOLENT", 1.1),
    ("threat", "WISH ~4 VIOLENT", 1.2),
    ("threat", "WISH ~2 YOU ~6 VIOLENT", 1.3),
    ("insult", "VOCATIVE ~2 WEAKINSULT", 1.05),
    ("hate", "GROUP ~8 DEMEAN", 1.2),
    ("hate", "GROUP ~2 DEMEANVERB", 1.1),
    ("hate", "DEMEAN ~6 GROUP", 1.0),
    ("hate", "GROUP ~14 EXPEL", 1.2),
    ("hate", "GROUP ~14 HANG", 1.1),
    ("hate", "EXPEL ~4 GROUP", 1.1),
    ("hate", "OUT ~3 GROUP", 1.0),
    ("hate", "GROUP ~14 DEMEAN ~8 EXPEL", 1.5),
    ("hate", "WHO ~2 DEMEAN ~4 EXPEL", 1.1),
    ("hate", "OUT ~2 PACK", 1.1),
    ("hate", "THEY BE ~3 DEMEAN", 0.8),
    ("hate", "ANY PEOPLE ~1 BE ~5 DEMEAN", 1.2),
    ("hate", "ANY PEOPLE ~1 BE ~5 DEMEAN ~8 EXPEL", 1.5),
    ("hate", "PEOPLE BE ~5 DEMEAN", 1.1),
    ("hate", "PEOPLE DEMEANVERB", 1.0),
    ("hate", "PEOPLE ~1 DEMEANVERB ~1 DEMEANVERB", 1.2),
    ("hate", "PEOPLE ~8 ESSENCE", 1.0),
    ("hate", "TYPICAL PEOPLE ~3 DEMEAN", 1.2),
    ("hate", "WHOEVER PEOPLE ~5 DEMEAN", 1.0),
    ("hate", "ANY PEOPLE ~8 THEY ~3 DEMEAN", 1.2),
    ("hate", "ANY PEOPLE ~8 MUST ~3 EXPEL", 1.2),
    ("hate", "ANY PEOPLE ~14 HANG", 1.1),
    ("hate", "DOWITH ~1 PEOPLE ~6 WATER ~1 DEEP", 1.1),
    ("hate", "OUT ~2 PEOPLE ~8 PACK", 1.1),
    ("hate", "SEND ~2 PEOPLE BACK", 1.1),
    ("hate", "SEND ~2 PEOPLE ~8 EXPEL", 1.2),
    ("sex", "SEX", 0.75),
    ("sex", "SEXYOU", 1.0),
    ("sex", "SEX ~8 SEX", 1.1),
    ("sex", "SEX ~8 SEXYOU", 1.3),
    ("sex", "SEXWEAK ~8 SEXYOU", 1.2),
    ("sex", "SEX ~4 PERSON", 1.1),
    ("sex", "YOU ~4 SEX", 1.3),
    ("sex", "SEX ~6 YOU", 1.1),
    ("sex", "I ~5 SEX", 1.3),
    ("sex", "SEX ~8 I", 1.0),
    ("sex", "I ~4 SEXWEAK ~6 YOU", 1.0),
    ("sex", "I ~3 YOU ~4 SEXWEAK", 1.0),
    ("sex", "SEXWEAK ~3 I ~3 YOU", 1.0),
    ("sex", "YOU ~2 SEXWEAK ~2 SEXWEAK", 1.0),
)
INITIAL = [weight for _, _, weight in PATTERNS]
LESS = {"INSULT": 0.9, "VIOLENT": 0.7}  #: what a negation up to one word before takes away
CONTEXT = 0.9  #: what reported speech or a professional context takes away
REPORT_GAP, SAID_GAP, NEUTRAL_GAP, SEX_GAP = 8, 3, 8, 4  #: words between the context and the path
SAID = frozenset("nannte sagte zitat quoted".split())
AS = frozenset("als as comme come".split())
THAT = frozenset("dass that que che wonach".split())  #: after a comma they go on with what was said
THRESHOLD = 0.95

_CLASSES = tuple(WORDS)
_BIT = {c: 1 << i for i, c in enumerate(_CLASSES)}
_NEEDS = {sum({_BIT[c] for c in text.split() if c in _BIT}) for _, text, _ in PATTERNS}  #: classes of each pattern
_DISGUISED = sum(_BIT[c] for c in ("INSULT", "COMMAND", "SEX", "SEXYOU", "VIOLENT", "GROUP", "WEAKINSULT", "DEMEAN", "DEMEANVERB", "PACK", "EXPEL", "SEXWEAK"))
_TYPED = sum(_BIT[c] for c in ("INSULT", "COMMAND", "SEX", "GROUP"))
_NO_PEOPLE = _DISGUISED | sum(_BIT[c] for c in ("NEUTRAL", "REPORT", "PERSON", "BE", "MUST", "YOU", "I", "ANY", "WHO", "WHOEVER"))
#: Endings of names of peoples in the four languages; capitalised words only.
_PEOPLE = re.compile(r"[a-z]{2,}(?:er|ern|ers|ier|iern|iers|ese|esen|anen|aken|uken|olen|iten|ians?|eans?|ans|ais|ois|iens?|ains?|ani|esi|ini|ioti)$")
#: Classes that only frame others: a sentence without any other class of a pattern has no path.
_FRAMES = sum(_BIT[c] for c in ("YOU", "I", "WHO", "PERSON", "BE", "WISH", "PEOPLE", "ANY", "THEY", "MUST", "DOWITH", "WHOEVER", "TYPICAL", "VOCATIVE", "SEND", "OUT", "WATER"))
_CORE = reduce(operator.or_, _NEEDS) & ~_FRAMES
_PHRASED = 1 << len(_CLASSES)  #: a word that begins a phrase
_DIRECT = _BIT["YOU"] | _BIT["COMMAND"] | _BIT["WISH"]
_LITERAL = _BIT["DEMEAN"] | _BIT["BEAST"]  #: words with a plain meaning too
_FRAME = sum(_BIT[c] for c in ("YOU", "I", "WHO", "PERSON", "BE", "WISH", "GROUP", "PEOPLE", "ANY", "THEY", "MUST", "DOWITH", "WHOEVER", "TYPICAL", "VOCATIVE"))
_AROUND = _BIT["NOT"] | _BIT["REPORT"] | _BIT["NEUTRAL"]
_BREAK = re.compile(r"[,:()]|\s[-–—]+\s")
_QUOTE = re.compile(r"[\"«»„“”]")
_TRIPLE = re.compile(r"(.)\1\1")
_SENTENCE = re.compile(r"(?<=[.!?;])[\"'»)]*\s+(?=[^\W\d_])|(?<=[.!?;])[\"'»)]*\s*\n\s*|\n[^\S\n]*\n\s*|;")
_LINE_END = re.compile(r"\r\n?|[\u2028\u2029\x0b\x0c\x85]")
_HYPHEN = re.compile(r"(?<=[^\W\d_])[-\u00ad]\n[^\S\n]*(?=[^\W\d_])")
_SPACED = re.compile(r"(?<![\w])(?:[^\W\d_][ .\-_*]{1,2}){2,}[^\W\d_](?![\w])")
_WORD = re.compile(r"[^\W_]+(?:[*#@$!€][\w*#@$!€]*[\w*#])?|[\w@$€*]+", re.U)
_LEET = str.maketrans("013457@$€!|", "oieastasei" + "l")
_LEET_L = str.maketrans("1", "l")
_RUNS = re.compile(r"(.)\1+")


def _umlaut(text: str) -> str:
    """Lower case, umlauts written out, other accents and look-alikes folded; of a word or a text."""
    t = text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower().replace("ä", "ae").replace("ö", "oe").replace("ü", "ue")
    return folded(t)


def squeezed(word: str) -> str:
    return _RUNS.sub(r"\1", word)


class Lexicon:
    """Words and phrases to class bits, with undoing of disguises."""

    def __init__(self):
        self.words: dict[str, int] = {}
        self.stems: dict[str, int] = {}
        self.phrases: dict[str, list[tuple[tuple[str, ...], int]]] = {}
        for name, text in WORDS.items():
            for entry in text.split():
                self._add(entry, _BIT[name])
        for name, text in PHRASES.items():
            for entry in text.split("|"):
                self._add(entry, _BIT[name])
        strong = {w for w, bits in self.words.items() if bits & _DISGUISED and len(w) > 3}
        parts = {p for entries in self.phrases.values() for words, _ in entries for p in words if len(p) > 3}
        self.hidden: dict[tuple[str, str, int], list[str]] = {}
        self.squeezed: dict[str, str] = {}
        for w in sorted(strong | parts, key=lambda w: (w not in strong, not self.words.get(w, 0) & _BIT["INSULT"], w)):
            self.hidden.setdefault((w[0], w[-1], len(w)), []).append(w)
            self.squeezed.setdefault(squeezed(w), w)
        self.near: dict[str, str] = {}
        for w in sorted(strong):
            if len(w) > 6 and self.words[w] & _TYPED:
                for i in range(len(w)):
                    self.near.setdefault(w[:i] + "?" + w[i + 1 :], w)
                    self.near.setdefault(w[:i] + w[i + 1 :], w)
                    if i + 1 < len(w):
                        self.near.setdefault(w[:i] + w[i + 1] + w[i] + w[i + 2 :], w)
        commands = {p for words, bit in (e for es in self.phrases.values() for e in es) if bit == _BIT["COMMAND"] for p in words if len(p) > 6}
        for w in sorted(commands):
            for i in range(len(w)):
                self.near.setdefault(w[:i] + "?" + w[i + 1 :], w)
                self.near.setdefault(w[:i] + w[i + 1 :], w)
        for w in sorted(strong):
            if len(w) > 5 and not self.words[w] & _TYPED:
                for i in range(1, len(w) - 1):
                    self.near.setdefault(w[:i] + w[i + 1] + w[i] + w[i + 2 :], w)
        self.written: dict[str, str] = {}
        self.cache: dict[str, int] = {}

    def _add(self, entry: str, bit: int) -> None:
        parts = entry.split(" ")
        if len(parts) > 1:
            self.phrases.setdefault(parts[0], []).append((tuple(parts), bit))
        elif entry.endswith("*"):
            self.stems[entry[:-1]] = self.stems.get(entry[:-1], 0) | bit
        else:
            self.words[entry] = self.words.get(entry, 0) | bit

    def undisguised(self, word: str) -> str:
        """The lexicon word a folded word is meant to be, or the word itself."""
        got = self.written.get(word)
        if got is None:
            if len(self.written) > 300_000:
                self.written.clear()
            got = self.written[word] = self._undisguised(word)
        return got

    def _undisguised(self, word: str) -> str:
        if len(word) < 4 or word in self.words:
            return word
        if "*" in word or "#" in word:
            if word[0].isalpha() and word[-1].isalpha():
                shown = word.replace("#", "*")
                for w in self.hidden.get((shown[0], shown[-1], len(shown)), ()):
                    if all(a in ("*", b) for a, b in zip(shown, w)):
                        return w
            return word
        if not word.isalpha():
            if any(c.isalpha() for c in word):
                for form in (word.translate(_LEET), word.translate(_LEET_L).translate(_LEET)):
                    if form.isalpha():
                        if self.words.get(form, 0) or self.squeezed.get(squeezed(form)) == form or self._stem(form):
                            return form
                        if squeezed(form) in self.squeezed:
                            return self.squeezed[squeezed(form)]
            return word
        if _TRIPLE.search(word) and squeezed(word) in self.squeezed:
            return self.squeezed[squeezed(word)]
        if len(word) > 5 and word in self.near:
            return self.near[word]
        if len(word) > 6:
            if squeezed(word) != word and squeezed(word) in self.squeezed and self.words.get(self.squeezed[squeezed(word)], 0) & _TYPED:
                return self.squeezed[squeezed(word)]
            for i in range(len(word)):
                if (w := self.near.get(word[:i] + "?" + word[i + 1 :])) or (w := word[:i] + word[i + 1 :]) in self.words and self.words[w] & _TYPED and len(w) > 6:
                    return w
        return word

    def of(self, word: str) -> int:
        """Class bits of a folded word, disguised or not."""
        bits = self.cache.get(word)
        if bits is None:
            if len(self.cache) > 300_000:
                self.cache.clear()
            plain = self.undisguised(word)
            bits = self.cache[word] = self.words.get(plain, 0) | self._stem(plain)
        return bits

    def _stem(self, word: str) -> int:
        bits = 0
        for n in range(4, len(word) + 1):
            bits |= self.stems.get(word[:n], 0)
        return bits

    def people(self, raw: str, word: str) -> int:
        """The bit of a word that has the form of a people's name."""
        return _BIT["PEOPLE"] if len(word) > 4 and raw[0].isupper() and _PEOPLE.search(word) and not self.of(word) & _NO_PEOPLE else 0

    def add_phrases(self, words: list[str], classes: list[int]) -> int:
        """Adds the bits of phrases to those of the words they begin with; returns the bits added."""
        plain, added = [self.undisguised(w) for w in words], 0
        for i, c in enumerate(classes):
            if c & _PHRASED:
                for parts, bit in self.phrases.get(plain[i], ()):
                    if tuple(plain[i : i + len(parts)]) == parts:
                        classes[i] |= bit
                        added |= bit
        return added


class Grammar:
    """Union of the pattern transducers: chains of classes with bounded gaps, best path by weight."""

    def __init__(self, weights: list[float] | None = None):
        self.chains = []
        for (label, text, _), weight in zip(PATTERNS, weights or INITIAL):
            steps, gap = [], 0
            for item in text.split():
                if item.startswith("~"):
                    gap = int(item[1:])
                else:
                    steps.append((_BIT[item], gap))
                    gap = 0
            need = 0
            for bit, _ in steps:
                need |= bit
            self.chains.append((label, steps, weight, need))

    @staticmethod
    def accepts(steps: list[tuple[int, int]], classes: list[int]) -> bool:
        """Whether a chain has a path through the sentence; each arc takes a later word."""
        first = steps[0][0]
        live = {i for i, c in enumerate(classes) if c & first}
        for bit, gap in steps[1:]:
            live = {j for i in live for j in range(i + 1, min(len(classes), i + 2 + gap)) if classes[j] & bit}
            if not live:
                return False
        return bool(live)

    @staticmethod
    def paths(steps: list[tuple[int, int]], classes: list[int]) -> Iterator[tuple[int, ...]]:
        """The words of each path of a chain."""
        first = steps[0][0]
        for i, c in enumerate(classes):
            if c & first:
                live = [(i,)]
                for bit, gap in steps[1:]:
                    live = [(*p, j) for p in live for j in range(p[-1] + 1, min(len(classes), p[-1] + 2 + gap)) if classes[j] & bit]
                yield from live

    def less(self, classes: list[int], around: Around | None = None) -> dict[int, float]:
        """What the context takes at least from the paths of each pattern that has one."""
        present, out = 0, {}
        for c in classes:
            present |= c
        for k, (_, steps, _, need) in enumerate(self.chains):
            if not need & ~present and (found := [around.less(steps, p) if around else 0.0 for p in self.paths(steps, classes)]):
                out[k] = min(found)
        return out

    def score(self, classes: list[int], around: Around | None = None) -> tuple[float, str]:
        """(score, label) of a sentence: its heaviest path, less what the context of that path takes away."""
        present = 0
        for c in classes:
            present |= c
        best, label = 0.0, ""
        for name, steps, weight, need in self.chains:
            if need & ~present or weight <= best:
                continue
            if around is None or not present & _AROUND:
                if self.accepts(steps, classes):
                    best, label = weight, name
                continue
            for path in self.paths(steps, classes):
                got = weight - around.less(steps, path)
                if got > best:
                    best, label = got, name
                    if got == weight:
                        break
        return best, label


class Around:
    """What stands around the paths of a sentence: its words, their classes, clauses and quotation."""

    def __init__(self, words: list[str], classes: list[int], breaks: list[str], quoted: list[bool]):
        self.words, self.classes, self.quoted = words, classes, quoted
        self.hard, self.comma, hard, comma = [], [], 0, 0  # breaks up to each word, without colons; commas only
        for w, b in zip(words, breaks):
            if b and w not in THAT:
                hard += b != ":"
                comma += b == ","
            self.hard.append(hard)
            self.comma.append(comma)
        self.reports = [i for i, c in enumerate(classes) if c & _BIT["REPORT"]]
        self.neutral = [i for i, c in enumerate(classes) if c & _BIT["NEUTRAL"]]
        self.breaks = breaks

    def less(self, steps: list[tuple[int, int]], path: tuple[int, ...]) -> float:
        """What negation, reported speech and professional contexts take from a path."""
        all_of, out = 0, 0.0
        for bit, _ in steps:
            all_of |= bit
        for name, by in LESS.items():
            if any(bit == _BIT[name] and any(self.classes[k] & _BIT["NOT"] for k in range(max(0, i - 2), i)) for (bit, _), i in zip(steps, path)):
                out += by
        if self.reports and any(self._reported(r, all_of, path) for r in self._near(self.reports, path, REPORT_GAP)):
            out += CONTEXT
        if self.neutral and any(self._plain(n, all_of, steps, path) for n in self._near(self.neutral, path, NEUTRAL_GAP)):
            out += CONTEXT
        return out

    @staticmethod
    def _near(at: list[int], path: tuple[int, ...], gap: int) -> list[int]:
        return at[bisect_left(at, path[0] - gap - 1) : bisect_left(at, path[-1] + gap + 2)]

    def _reported(self, r: int, all_of: int, path: tuple[int, ...]) -> bool:
        a, b = path[0], path[-1]
        gap = a - r - 1 if r < a else r - b - 1  # negative within the path
        if gap > REPORT_GAP:
            return False
        if not self.quoted[r] and all(self.quoted[i] for i in path):
            return True
        same = self.hard[min(a, r)] == self.hard[max(b, r)]
        if any(self.words[k] in AS for k in range(max(0, b - 2), b)) and same:  # called an idiot
            return True
        if gap < 0:
            return same and r not in path
        said = r < a and gap < SAID_GAP and (self.words[r] in SAID or ":" in self.breaks[r + 1 : a + 1])
        if all_of & _DIRECT:
            return said and same
        if said and self.hard[a] - self.hard[r] == self.comma[a] - self.comma[r] <= 1:
            return True
        return same and not self._stated(all_of, path)

    def _stated(self, all_of: int, path: tuple[int, ...]) -> bool:
        """Whether a path says of a group what it is."""
        return bool(all_of & (_BIT["GROUP"] | _BIT["PEOPLE"])) and any(self.classes[k] & _BIT["BE"] or self.words[k] in ("sont", "sono") for k in range(path[0] + 1, path[-1]))

    def _plain(self, n: int, all_of: int, steps: list[tuple[int, int]], path: tuple[int, ...]) -> bool:
        a, b = path[0], path[-1]
        gap = a - n - 1 if n < a else n - b - 1
        core = [self.classes[i] for (bit, _), i in zip(steps, path) if not bit & _FRAME]
        if all_of & (_BIT["SEX"] | _BIT["SEXWEAK"]):
            return not all_of & _BIT["YOU"] and gap <= (SEX_GAP if all_of & _BIT["I"] else NEUTRAL_GAP)
        return all(c & _LITERAL for c in core) and gap <= NEUTRAL_GAP and not self._stated(all_of, path)


class Scorer:
    def __init__(self, weights: list[float] | None = None):
        self.lexicon, self.grammar = Lexicon(), Grammar(weights)
        self.written: dict[str, tuple[str, int]] = {}

    def word(self, raw: str) -> tuple[str, int]:
        """A word folded, and its class bits."""
        got = self.written.get(raw)
        if got is None:
            if len(self.written) > 300_000:
                self.written.clear()
            word = _umlaut(raw)
            got = self.written[raw] = word, self.lexicon.of(word) | self.lexicon.people(raw, word) | _PHRASED * (self.lexicon.undisguised(word) in self.lexicon.phrases)
        return got

    @staticmethod
    def _joined(sentence: str) -> str:
        if _SPACED.search(sentence):
            sentence = _SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m[0]), sentence)
        return sentence

    def around(self, sentence: str, words: list[str], classes: list[int]) -> Around:
        """The context of the words of a sentence; an open quotation goes on to its end."""
        breaks, quoted, at, inside = [], [], 0, False
        text = self._joined(sentence)
        for m in _WORD.finditer(text):
            between = text[at : m.start()]
            inside ^= len(_QUOTE.findall(between)) % 2 == 1
            found = _BREAK.findall(between)
            breaks.append(":" if ":" in found else "," if "," in found else "-" if found else "")
            quoted.append(inside)
            at = m.end()
        for i, b in enumerate(breaks):  # a target that opens a short clause: ", du ..."
            if b and classes[i] & _BIT["YOU"] and next((k for k in range(i + 1, len(breaks)) if breaks[k]), len(breaks)) - i < 6:
                classes[i] |= _BIT["VOCATIVE"]
        return Around(words, classes, breaks, quoted)

    def parsed(self, text: str) -> Iterator[tuple[str, list[int], Around]]:
        """(sentence, class bits of its words, what stands around them) of the sentences that may have a path."""
        text = _LINE_END.sub("\n", text if text.isascii() else bare(unicodedata.normalize("NFC", text)))
        for sentence in _SENTENCE.split(_HYPHEN.sub("", text) if "\n" in text else text):
            if not sentence:
                continue
            raws = _WORD.findall(self._joined(sentence))
            hot, words, classes = 0, [], []
            for raw in raws:
                word, bits = self.word(raw)
                hot |= bits
                words.append(word)
                classes.append(bits)
            if hot & _PHRASED:
                hot |= self.lexicon.add_phrases(words, classes)
            if not hot & _CORE:
                continue
            hot |= _BIT["VOCATIVE"]
            if all(need & ~hot for need in _NEEDS):
                continue
            yield sentence, classes, self.around(sentence, words, classes)

    def sentences(self, text: str) -> list[tuple[str, float, str]]:
        """(sentence, score, label) of the sentences with a score."""
        out = []
        for sentence, classes, around in self.parsed(text):
            score, label = self.grammar.score(classes, around if any(c & _AROUND for c in classes) else None)
            if score > 0:
                out.append((sentence, score, label))
        return out

    def score(self, text: str | None) -> tuple[float, str]:
        """(score, label) of a text: its heaviest sentence, a little more for each further one."""
        found = sorted(((s, label) for _, s, label in self.sentences(text or "")), reverse=True)
        if not found:
            return 0.0, ""
        top = found[0][0]
        return round(top + 0.01 * sum(s >= THRESHOLD for s, _ in found[1:]), 4), found[0][1]


EXAMPLES = 5_000  #: judged examples that weights are fitted to at most


def fitted(examples: Iterable[tuple[str | None, int]], *, pull: float = 4.0, rounds: int = 60, rate: float = 0.02) -> list[float]:
    """Weights of the patterns after training on judged texts: gradient steps of a logistic loss on the heaviest path of
    each text, pulled back to the initial weights, so patterns that no example has keep theirs."""
    scorer, seen = Scorer(), []
    for text, judged in examples:
        paths: dict[int, float] = {}
        for _, classes, around in scorer.parsed(text or ""):
            for k, less in scorer.grammar.less(classes, around).items():
                paths[k] = min(less, paths.get(k, 9.0))
        if paths:
            seen.append((paths, float(judged)))
    weights = list(INITIAL)
    for _ in range(rounds):
        step = [pull * (a - w) for a, w in zip(INITIAL, weights)]
        for paths, judged in seen:
            best = max(paths, key=lambda k: (weights[k] - paths[k], -k))
            step[best] += judged - 1 / (1 + math.exp(-8 * (weights[best] - paths[best] - THRESHOLD)))
        weights = [max(0.0, w + rate * d / max(1.0, pull)) for w, d in zip(weights, step)]
    return [round(w, 4) for w in weights]


def weights_from(examples: DataFrame, text_col: str = "text", judged_col: str = "abusive", order: str = "example_id") -> list[float]:
    """``fitted`` to a table of judged texts, the first ``EXAMPLES`` by ``order``."""
    rows = examples.where(F.col(judged_col).isNotNull()).orderBy(order).limit(EXAMPLES)
    return fitted([(r[0], r[1]) for r in rows.select(F.col(text_col).cast("string"), F.col(judged_col).cast("int")).collect()])


_scorers: dict[tuple, Scorer] = {}  #: of a worker: what it knows of words serves all its tasks


def scorer_of(weights: list[float] | None) -> Scorer:
    key = tuple(weights or INITIAL)
    if key not in _scorers:
        _scorers.clear()
        _scorers[key] = Scorer(list(key))
    return _scorers[key]


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, weights: list[float] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(``id_col``, columns of ``keep``, abuse_score, abuse_kind) of every document; null, empty and blank texts score 0
    with kind ''.

    Every sentence of a text is scored, however long it is; rows are neither shuffled nor dropped. ``weights`` are those
    of the patterns, initially ``INITIAL``.
    """
    c_text = free_name("_text", [id_col, *keep])
    picked = docs.select(id_col, *keep, F.col(text_col).cast("string").alias(c_text))
    names = [id_col, *keep, "abuse_score", "abuse_kind"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(weights)
        for batch in batches:
            got = [scorer.score(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([s for s, _ in got], pa.float64()), pa.array([k for _, k in got], pa.string())], names=names)

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(run, f"{kept}, abuse_score double, abuse_kind string")
