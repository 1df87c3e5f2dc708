"""Freely typed values mapped to the entries of a reference list.

A symmetric-delete dictionary of the reference (its size is checked) goes to every worker; a value is looked up
within a bounded edit distance, candidates are ranked by weighted Damerau-Levenshtein distance and then by how
often their entry occurs, and values with no candidate are reported with -1.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.chars import free_name
from ledgerloom.llm.names import Deletes, fold_name, parse, weighted

#: Entries that may be sent to the workers at once; a larger list is looked up in blocks of this size.
BLOCK = 50_000

# What receipts of each type are called, besides the names of the reference list.
SYNONYMS = {
    "lohnausweis": "lohnausweis|lohnausw|lohn ausweis|lohnzettel|jahreslohnausweis|lohn rente ausweis|lohnabrechnung|rentenbescheinigung|rentenausweis|lohnbescheinigung|certificat de salaire|attestation de salaire|salary certificate|salary statement|certificato di salario",
    "bank_zinsausweis": "bank zinsausweis|zinsausweis|zinsausweis bank|bank zins ausweis|kontozinsen|zinsbescheinigung konto|zinsbescheinigung|bankauszug zinsen|kontoauszug zinsen|zinsabschluss|attestation d interets|bank interest statement|attestazione interessi",
    "kk_praemienbescheinigung": "kk praemienbescheinigung|kk praemien|kk bescheinig|kk bescheinigung|krankenkasse praemien|krankenkassenpraemie|krankenkassenpraemien|praemienbescheinigung kk|praemienbescheinigung krankenkasse|praemienbescheinigung|praemienausweis kvg vvg|praemienausweis|attestation de primes maladie|primes maladie|health insurance premiums|premi cassa malati",
    "saeule_3a": "saeule 3a|saeule3a|3 saeule a|3a|3a einzahlung|vorsorge 3a bescheinigung|vorsorge 3a|dritte saeule|pilier 3a|3e pilier a|troisieme pilier a|pillar 3a|pilastro 3a",
    "wertschriftenverzeichnis": "wertschriftenverzeichnis|wertschr verz|wertschriften|depotauszug|wv depot|steuerverzeichnis depot|steuerverzeichnis|depotverzeichnis|etat des titres|releve de titres|securities statement|elenco dei titoli",
    "spenden": "spenden|spende|spendenbestaetigung|spendenquittung|zuwendung gemeinnuetzig|zuwendung|zuwendungsbescheinigung|vergabung|don|dons|attestation de don|donation|donazione",
    "berufsauslagen": "berufsauslagen|berufs auslagen|berufskosten|weiterbildung|weiterbildungskosten|kurskosten beruflich|kurskosten|gewinnungskosten|frais professionnels|professional expenses|spese professionali",
    "kinderbetreuung": "kinderbetreuung|kinder betreuung|kita|krippe|kinderkrippe|hort tagesfamilie|hort|tagesfamilie|betreuungskosten|garde d enfants|frais de garde|childcare|custodia bambini",
    "hypothek_zinsbestaetigung": "hypothek zinsbestaetigung|hypothek|hypothekarzins|hypothekarzinsen|hypothekenzins|hypothekenzinsen|hypo zinsen|schuldzinsen hypothek|schuldzinsen|zinsbest hypothek|zinsbestaetigung hypothek|interets hypothecaires|mortgage interest|interessi ipotecari",
    "liegenschaftsunterhalt": "liegenschaftsunterhalt|liegenschafts unterhalt|liegenschaftsunterh|unterhalt liegenschaft|hausunterhalt|lu haus|renovation haus|renovation|rechnung unterhalt|entretien d immeuble|property maintenance|manutenzione immobile",
    "krankheitskosten": "krankheitskosten|krankheits kosten|arztkosten|arztrechnung|zahnarzt|zahnarztrechnung|apotheke arzt|apotheke|rueckforderungsbeleg|frais medicaux|medical expenses|spese mediche",
    "freizuegigkeitskonto": "freizuegigkeitskonto|freizuegigkeitskto|freizuegigkeit|fz konto|fzk|freizuegigkeitsguthaben|libre passage|compte de libre passage|vested benefits account|libero passaggio",
}

_YEAR = re.compile(r"\b(19|20)\d\d\b")
_MARKS = re.compile(r"[^a-z0-9]+")
_LINKING_S = re.compile(r"(?<=[a-z]{4})s (?=[a-z]{4})")  #: between the parts of a compound, often left out


def plain_label(text: str) -> str:
    """Letters and digits in words, folded, without a year."""
    return _MARKS.sub(" ", _YEAR.sub(" ", fold_name(text).replace("_", " "))).strip()


def _allowed(size: int) -> int:
    return 0 if size < 4 else 1 if size < 9 else 2


class Labels:
    """Lookup of labels: equal words first, then the same letters, then within the edits their length allows."""

    def __init__(self, entries: list[tuple[int, str, bool]], weight: dict[int, int]):
        self.exact: dict[str, int] = {}
        for ref, label in ((r, form) for r, t, _ in entries for form in {plain_label(t), _LINKING_S.sub("", plain_label(t))}):
            key = label.replace(" ", "")
            if key and (key not in self.exact or (-weight.get(ref, 0), ref) < (-weight.get(self.exact[key], 0), self.exact[key])):
                self.exact[key] = ref
        self.deletes = Deletes(self.exact, most=2)
        self.weight = weight

    def best(self, text: str) -> tuple[float, int, int] | None:
        """(cost, minus frequency, entry) of the best entry."""
        key = plain_label(text).replace(" ", "")
        if not key:
            return None
        if key in self.exact:
            return 0.0, -self.weight.get(self.exact[key], 0), self.exact[key]
        most = _allowed(len(key))
        if not most:
            return None
        near = [w for d, w in self.deletes.near(key, most) if d <= _allowed(min(len(w), len(key)))]
        found = ((round(weighted(key, w), 3), -self.weight.get(self.exact[w], 0), self.exact[w]) for w in near)
        return min(found, default=None)


class Issuers:
    """Lookup of issuers: the coined word within one edit, in the same line of business.

    An entry comes with whether no other entry of the whole reference has its coined word: a value without a line of
    business means it only then.
    """

    def __init__(self, entries: list[tuple[int, str, bool]], weight: dict[int, int]):
        self.weight = weight
        self.by_core: dict[str, list[tuple[int, str, tuple[str, ...], bool]]] = {}
        self.whole: dict[str, int] = {}
        for ref, text, sole in entries:
            name, key = parse(text), plain_label(text)
            if key not in self.whole or (-weight.get(ref, 0), ref) < (-weight.get(self.whole[key], 0), self.whole[key]):
                self.whole[key] = ref
            if name.words:
                self.by_core.setdefault(name.words[0], []).append((ref, name.trade, tuple(name.words[1:]), sole))
        self.deletes = Deletes(self.by_core)

    def best(self, text: str) -> tuple[float, int, int] | None:
        """(cost, minus frequency, entry) of the best entry; an earlier word of the value goes before a later one."""
        whole = self.whole.get(plain_label(text))
        if whole is not None:
            return -1.0, -self.weight.get(whole, 0), whole
        name = parse(text)
        if name.kind not in ("org", "person") or not name.words:
            return None
        for place, word in enumerate(name.words):
            found = []
            for _, core in self.deletes.near(word, 1 if len(word) > 4 else 0):
                for ref, trade, rest, sole in self.by_core[core]:
                    lone = not name.trade and name.kind == "org"
                    if lone and not sole:  # one of several: none of them, nor a farther one
                        found.append((10 * place + round(weighted(word, core), 3), 0, -1))
                        lone = False
                    if (trade == name.trade or lone) and (not rest or set(rest) <= set(name.words)):
                        found.append((10 * place + round(weighted(word, core), 3), -self.weight.get(ref, 0), ref))
            if found:
                return min(found)
        return None


def _cores(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, text) -> with the coined word of the text."""
    for batch in batches:
        cores = [(parse(t).words or [""])[0] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cores, pa.string())], names=["r", "t", "core"])


def _with_soles(entries: DataFrame, kind: str) -> DataFrame:
    """(r, t, sole): the texts of the reference, and whether no other one of the whole reference has its coined word."""
    if kind != "issuer":
        return entries.withColumn("sole", F.lit(False))
    cored = entries.mapInArrow(_cores, "r bigint, t string, core string")
    return cored.join(cored.groupBy("core").agg((F.count("*") == 1).alias("sole")), "core").select("r", "t", "sole")


def matched(
    rows: DataFrame,
    reference: DataFrame,
    *,
    value: str,
    ref_id: str,
    ref_names: list[str],
    kind: str,
    synonyms: dict[str, str] | None = None,
    out: str = "ref_found",
) -> DataFrame:
    """``rows`` with the id of the reference entry that ``value`` means in column ``out``, or -1 for none.

    Null values are kept with -1; blank ones have none. The reference is looked up in blocks of ``BLOCK`` entries,
    each of which goes to the workers by itself and improves on the one before, so what is sent is bounded whatever
    the list's length and the answers are those of one block; the rows are never shuffled, so a value that a third of them share makes no hot task. Other columns pass through
    untouched, but one called like ``out`` is replaced.
    """
    rows = rows.drop(out) if out != value else rows
    texts = F.explode(F.array(*[F.col(c).cast("string") for c in ref_names]))
    entries = _with_soles(reference.select(F.col(ref_id).cast("bigint").alias("r"), texts.alias("t")).where("r is not null and t <> ''").distinct(), kind)
    blocks = max(1, -(-reference.count() // BLOCK))
    cost, rank = (free_name(n, [*rows.columns, out]) for n in ("_cost", "_rank"))
    result = rows.select("*", F.lit(None).cast("double").alias(cost), F.lit(None).cast("bigint").alias(rank), F.lit(-1).cast("bigint").alias(out))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in result.schema)
    for k in range(blocks):
        table = (entries if blocks == 1 else entries.where(F.pmod(F.xxhash64("r"), F.lit(blocks)) == k)).orderBy("r", "t").collect()
        result = result.mapInArrow(_lookup(rows, table, value, kind, synonyms or {}, cost, rank, out), columns)
    return result.drop(cost, rank)


def _lookup(rows: DataFrame, table: list, value: str, kind: str, synonyms: dict[str, str], cost: str, rank: str, out: str):
    """The mapping of batches by one block of the reference."""
    spark = rows.sparkSession
    listed = [(r.r, r.t, r.sole) for r in table]
    named: dict[str, list[int]] = {}
    for ref, t, _ in listed:
        named.setdefault(t, []).append(ref)
    wanted = spark.createDataFrame([(t,) for t in named] or [("",)], "v string")  # at most a block
    counted = rows.select(F.col(value).cast("string").alias("v")).join(F.broadcast(wanted), "v", "left_semi")
    weight: dict[int, int] = {}
    for r in counted.groupBy("v").count().collect():  # at most one row an entry
        for ref in named.get(r.v, ()):
            weight[ref] = weight.get(ref, 0) + r["count"]
    listed += [(ref, s, False) for key, words in synonyms.items() for ref in named.get(key, ()) for s in words.split("|")]
    held = spark.sparkContext.broadcast((listed, weight))
    of = {"issuer": Issuers, "label": Labels}[kind]

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, seen = of(*held.value), {}
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            costs, ranks, refs = [], [], []
            before = zip(*(batch.column(at[c]).to_pylist() for c in (value, cost, rank, out)))
            for text, c, w, ref in before:
                best = None
                if isinstance(text, str):
                    if text not in seen:
                        if len(seen) > 500_000:
                            seen.clear()
                        seen[text] = lookup.best(text)
                    best = seen[text]
                if best is not None and (c is None or best < (c, w, ref)):
                    c, w, ref = best
                costs.append(c)
                ranks.append(w)
                refs.append(ref)
            arrays = list(batch.columns)
            arrays[at[cost]], arrays[at[rank]], arrays[at[out]] = pa.array(costs, pa.float64()), pa.array(ranks, pa.int64()), pa.array(refs, pa.int64())
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return look
