"""Spellings of names typed by people, linked where they mean the same organisation or person.

Names are reduced to their parts (line of business, coined words or given name and surname). A symmetric-delete
neighbourhood index of these finds parts within one edit of each other, long ones that sound alike within two: names meet under a
remainder after deletions, never all with all. Words for lines of business are learned from the corpus. Candidates are aligned word by word by optimal assignment, in which an initial
stands for its name. What is left are links between distinct parts, a small table; components of it group the
spellings. Acronyms, initials, two slips and names without a line of business join a group only where one alone fits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.graph import components
from ledgerloom.llm.names import GIVEN, KNOWN, LONG, NICKNAMES, TRADES, Lines, Name, align, business_words, initials, keys, pair_cost, parse, short_for, sound
from ledgerloom.session import cut

BLOCK = 256  #: spellings of one group that meet in one block


PARTNERS = 25  #: different words beside which a word for a line of business stands at least
LEARNED = 20_000  #: such words that are sent to the workers at most


def _beside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(w, x): the pairs of words of names with a legal form that are neither abbreviated nor places."""
    for batch in batches:
        out = set()
        for text in batch["name"]:
            found = business_words(text)
            out |= {(w, x) for w in found for x in found if w != x}
        yield pd.DataFrame(sorted(out), columns=["w", "x"])


def learned_lines(names: DataFrame) -> list[str]:
    """Words that stand beside many different words, most of which stand beside few: lines of business, not surnames,
    whose neighbours are lines of business. Those already known, or abbreviations of them, are left out."""
    pairs = names.mapInPandas(_beside, "w string, x string").distinct()
    degree = pairs.groupBy("w").agg(F.count("*").alias("n"))
    often = degree.where(F.col("n") >= PARTNERS)
    of_x = degree.select(F.col("w").alias("x"), F.col("n").alias("m"))
    judged = pairs.join(often, "w").join(of_x, "x").groupBy("w", "n").agg(F.avg((F.col("m") * 4 < F.col("n")).cast("int")).alias("few"))
    found = [r.w for r in judged.where("few >= 0.8").select("w").orderBy("w").limit(LEARNED + 1).collect()]
    if len(found) > LEARNED:
        raise ValueError(f"more than {LEARNED} words look like lines of business: raise PARTNERS")
    return [w for w in found if not KNOWN.trade_of(w, False) and not KNOWN.trade_of(w, True)]


_lines: dict[tuple[str, ...], Lines] = {}  #: of a worker


def _lines_of(learned: tuple[str, ...]) -> Lines:
    if learned not in _lines:
        _lines.clear()
        _lines[learned] = Lines([*TRADES, *learned])
    return _lines[learned]


def _parts(learned: tuple[str, ...]):
    """name -> kind, trade, words (of persons sorted), marks (legal form, place), whether a Sankt stood before it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lines = _lines_of(learned)
        for batch in batches:
            rows = []
            for text in batch["name"]:
                n = parse(text, lines)
                rows.append((text, n.kind or "none", n.trade, " ".join(sorted(n.words) if n.kind == "person" else n.words), [k + v for k, v in (("l:", n.legal), ("p:", n.place)) if v], n.saint))
            yield pd.DataFrame(rows, columns=["name", "kind", "trade", "words", "marks", "saint"])

    return run


def _index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Index entries of a node. Roles s, e (two slips) and o (another order, or kind) meet their own; n (short given
    names) and w (weak forms) meet t of the same key."""
    for batch in batches:
        out = []
        for node, kind, trade, text, marks, saint in zip(*(batch[c] for c in ("node", "kind", "trade", "words", "marks", "saint"))):
            words = text.split(" ")
            core = "".join(words)
            if kind == "org" and trade:
                forms = keys(core) | (keys(core[:-2]) if core.endswith("er") and len(core) > 6 else set())
                letters = ("s" if saint else "") + initials(Name("org", words, trade))
                out += [(f"e|{trade}|{sound(core)}", "e", node, marks) for _ in range(len(core) >= LONG)]
                out += [(f"o|{trade}|{k}", "s", node, marks) for k in forms] + [(f"c|{core}", "t", node, marks), (f"a|{letters}", "t", node, marks)]
            elif kind == "org":
                out += [(f"n|{k}", "s", node, marks) for k in keys(core)] + [(f"c|{core}", "w", node, marks)]
                out += [(f"e||{sound(core)}", "e", node, marks) for _ in range(len(core) >= LONG)]
            elif kind == "acronym":
                out.append((f"a|{core}", "w", node, marks))
            elif kind == "person" and len(words) > 1:
                out += [(k, r, node, marks) for k, r in _person(words)]
            if kind in ("org", "person") and not trade and len(words) > 1 and not any(len(w) == 1 or w in GIVEN for w in words):
                out += [(f"r|{k}", "o", node, marks) for k in keys(" ".join(sorted(words)))]
        yield pd.DataFrame(out, columns=["key", "role", "node", "marks"]).drop_duplicates()


def _person(words: list[str]) -> Iterator[tuple[str, str]]:
    letters = [len(w) == 1 or len(w) == 2 and w not in NICKNAMES for w in words]  # initials, also of a double name
    weak = any(letters)
    for i, w in enumerate(words):
        others = words[:i] + words[i + 1 :]
        for k in keys(w) if len(w) > 3 else {w}:
            yield f"p|{len(words)}|{' '.join(others)}|{k}", "s"
        for j, x in enumerate(others):
            held = others[:j] + others[j + 1 :]
            marks = keys(x) if len(x) > 3 else set()
            if weak and letters[i]:
                yield from ((f"i|{' '.join(sorted([w[0], *held]))}|{k}", "w") for k in marks)
            elif not weak:
                yield from ((f"i|{' '.join(sorted([w[0], *held]))}|{k}", "t") for k in marks)
        if not weak and len(words) == 2:  # w may be a given name, the other word the surname
            for k in keys(others[0]) if len(others[0]) > 3 else ():
                yield from ((f"x|{k}|{form}", "t") for form in (f"={w}", f"f{w[:2]}", f"l{w[-2:]}"))
                if len(w) < 8:  # a full name of the list, or one that begins or ends alike
                    yield from ((f"x|{k}|{form}", "n") for form in (f"f{w[:2]}", f"l{w[-2:]}", *(f"={full}" for full in NICKNAMES.get(w, ()))))


def _compatible(a: str, b: str) -> bool:
    """No kind of mark is given on both sides without one in common."""
    x, y = a.split(",") if a else [], b.split(",") if b else []
    for kind in ("l:", "p:"):
        p, q = {m for m in x if m.startswith(kind)}, {m for m in y if m.startswith(kind)}
        if p and q and p.isdisjoint(q):
            return False
    return True


def _agree(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidate pairs of nodes (kind|trade|words) whose words align and whose legal forms and places, where given,
    agree, with the cost of the alignment."""
    for batch in batches:
        costs = [_cost(*x) for x in zip(*(batch[c] for c in ("a", "b", "role", "marks_a", "marks_b")))]
        out = batch.assign(cost=pd.array(costs, dtype="Float64"))
        yield out[out["cost"].notna()]


def _cost(a: str, b: str, role: str, marks_a: str, marks_b: str) -> float | None:
    ka, ta, wa = a.split("|", 2)
    kb, tb, wb = b.split("|", 2)
    x, y = wa.split(" "), wb.split(" ")
    if "acronym" in (ka, kb):
        return 0.0 if role == "w" else None
    if role == "n":
        found = [c for i in (0, 1) for j in (0, 1) if (c := pair_cost(x[i], y[j])) in (0.0, 1.0) and short_for(x[1 - i], y[1 - j])]
        return min(found, default=None)
    if role == "o":
        return align(x, y) if {ka, kb} != {"person"} and _compatible(marks_a, marks_b) else None
    if ka == "org":
        ok = _compatible(marks_a, marks_b) and (ta == tb or not ta or not tb)
        cost = align(["".join(x)], ["".join(y)], 2.0 if role == "e" else 1.5) if ok else None
        return cost if role != "e" or cost == 2.0 else None
    return align(x, y)


def _joined(groups: DataFrame, pairs: DataFrame, role: str) -> DataFrame:
    """(node, comp) after groups whose weak forms fit one other group best have joined it.

    Groups that fit equally well count as one once they have joined each other, so joins go on until none is left;
    what a group fits best is fixed before the first of them. The order of the joins does not change the result.
    """
    wish = pairs.where(F.col("role") == role).select(F.col("a").alias("weak"), F.col("b").alias("node"), "cost").join(groups, "node")
    ask = wish.join(groups.select(F.col("node").alias("weak"), F.col("comp").alias("from")), "weak").where("comp <> from")
    best = ask.groupBy("from").agg(F.min("cost").alias("cost"))
    asked = cut(ask.join(best, ["from", "cost"]).select("from", F.col("comp").alias("to")).distinct())
    if asked.isEmpty():
        return groups
    labels = asked.select(F.col("from").alias("comp")).union(asked.select("to")).distinct().withColumn("label", F.col("comp"))
    while True:
        label = lambda c: labels.select(F.col("comp").alias(c), F.col("label").alias(f"{c}_label"))  # noqa: B023, E731
        fits = asked.join(label("from"), "from").join(label("to"), "to").groupBy("from").agg(F.first("from_label").alias("a"), F.min("to_label").alias("b"), F.max("to_label").alias("other"))
        sole = cut(fits.where("b = other and a <> b").select("a", "b"))
        if sole.isEmpty():
            return cut(groups.join(labels, "comp", "left").select("node", F.coalesce("label", "comp").alias("comp")))
        joined = components(sole).select(F.col("node").alias("label"), F.col("comp").alias("least"))
        labels = cut(labels.join(joined, "label", "left").select("comp", F.coalesce("least", "label").alias("label")))


def linked(names: DataFrame) -> DataFrame:
    """(name, entity): each distinct non-blank value of column ``name`` with the least part-key of its group.

    Null and blank names are left out; a name no other means is a group of its own; repeated rows count once.
    """
    distinct = names.select(F.col("name").cast("string").alias("name")).where("trim(name) <> ''").distinct()
    distinct = cut(distinct)
    parts = distinct.mapInPandas(_parts(tuple(learned_lines(distinct))), "name string, kind string, trade string, words string, marks array<string>, saint boolean")
    named = cut(parts.withColumn("node", F.when(F.col("kind") == "none", F.concat(F.lit("none||"), "name")).otherwise(F.concat_ws("|", "kind", "trade", "words"))))
    every = named.select("node", F.explode("marks").alias("m")).distinct().groupBy("node").agg(F.array_join(F.array_sort(F.collect_list("m")), ",").alias("marks"))
    nodes = named.groupBy("node", "kind", "trade", "words").agg(F.max("saint").alias("saint")).join(every, "node", "left").fillna("", ["marks"])
    index = cut(nodes.where("kind <> 'none'").mapInPandas(_index, "key string, role string, node string, marks string"))

    side = lambda role, n: index.where(role).select("key", "role", F.col("node").alias(n), F.col("marks").alias(f"marks_{n}"))
    own = "role in ('s', 'e', 'o')"
    same = side(own, "a").join(side(own, "b"), ["key", "role"]).where("a < b")
    weak = side("role in ('n', 'w')", "a").join(side("role = 't'", "b").drop("role"), "key").where("a <> b")
    candidates = same.unionByName(weak).drop("key").distinct()
    pairs = cut(candidates.mapInPandas(_agree, "role string, a string, marks_a string, b string, marks_b string, cost double"))

    strong = components(pairs.where("role in ('s', 'o')").select("a", "b"))
    both_ways = pairs.where("role = 'e'")
    pairs = pairs.where("role <> 'e'").unionByName(both_ways).unionByName(both_ways.select("role", F.col("b").alias("a"), F.col("marks_b").alias("marks_a"), F.col("a").alias("b"), F.col("marks_a").alias("marks_b"), "cost"))
    groups = cut(nodes.select("node").distinct().join(strong, "node", "left").select("node", F.coalesce("comp", "node").alias("comp")))
    for role in ("n", "e", "w"):
        groups = _joined(groups, pairs, role)
    return named.select("name", "node").join(groups.withColumnRenamed("comp", "entity"), "node").select("name", "entity")


def name_pairs(groups: DataFrame) -> DataFrame:
    """(name_a, name_b): every two names of a group, the smaller in byte order first, in blocks of bounded size."""
    sizes = groups.groupBy("entity").agg(F.count("*").alias("n")).where("n > 1").select("entity", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    many = groups.join(sizes, "entity")
    left = many.select("entity", F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int").alias("block"), F.col("name").alias("name_a"))
    right = many.select("entity", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("name").alias("name_b"))
    return left.join(right, ["entity", "block"]).where("name_a < name_b").select("name_a", "name_b")
