"""Personal data by weak supervision: labelers vote, and a span classifier learns from their votes.

* Base spans: four patterns with their checks.  They always stay.
* Candidates beyond them: looser patterns of the same kinds (phone numbers
  without a plus sign, written-out addresses, ...) and base matches that fail
  their check.
* Labelers look at a span's form (regex), at lists of known parts (gazetteer)
  and at the words around it (context); each votes for, against, or abstains.
* Expectation-maximisation over the counts of vote patterns estimates how often
  each labeler is right and how likely each pattern is personal data.  It is
  anchored at both ends: base spans are known to be personal data, and a span
  that is part of a longer token or fails a checksum is known not to be (and
  can never be added).  A labeler cannot become worse than chance, so the two
  classes cannot change places.
* The posteriors train the final classifier, a naive Bayes model of what the
  span and its surroundings look like (length, separators, neighbouring
  characters, the word before), none of it a vote.  A candidate that both the
  posterior and the classifier give ``THRESHOLD`` is added.

DataFrame expressions only.  What reaches the driver is one count per kind,
vote pattern and feature value: a fixed number of combinations whatever the data.

Patterns are linear: possessive repeats never go back, and a match can start
inside a run of its characters only where the last match ended.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
THRESHOLD = 0.5
EM_ROUNDS = 200
CONTEXT = 40  # code points in front of a span that context labelers see

_PART = r"[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_PART})){_PART}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# looser forms; what overlaps a base span of any kind is not a candidate
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[(\x20](?:at|@)[\])\x20]\x20?[A-Za-z0-9-]{1,63}+"
             r"\x20?[\[(\x20](?:dot|\.)[\])\x20]\x20?[A-Za-z]{2,24}+(?![A-Za-z0-9])",
    "ip": r"(?i)(?<![0-9A-F:.])(?:[0-9A-F]{1,4}+:){7}+[0-9A-F]{1,4}+(?![0-9A-F:])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:(?:\x20[\x20-]\x20?|[./_\x{A0}])[0-9]{4}){3}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.-])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{3,4})[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])",
}
# known parts: gazetteers.  Country domains have two letters; these are the others
TOP_DOMAINS = ("com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "app", "dev", "online", "site", "xyz", "shop", "cloud")
MARKS = {
    "email": "e-?mails?|mail|correo|courriel|contact|kontakt|contacto|write to|reach me at|schreib an|adresse|address|dirección",
    "ip": "ips?|hosts?|servers?|clients?|address|adresse|dirección|servidor|serveur|gateway|router|login from|connected from",
    "card": "cards?|visa|mastercard|amex|credit|debit|karten?|kreditkarte|carte|tarjeta|payment|zahlung|paiement|pago|billing",
    "phone": "phone|tel|call|mobile|cell|fax|text me at|telefon|handy|ruf|nummer|téléphone|appelez|teléfono|móvil|llame|whatsapp",
}


def _digits(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
        return acc + twice
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), add) % 10 == 0


def _valid(kind: str, span: Column) -> Column:
    digits = _digits(span)
    if kind == "ip":
        return F.forall(F.split(span, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(
            "^([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])?$"))
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


_SPAN = "array<struct<start:int,end:int,span:string>>"
_BLOCK = 256  # matches whose places are summed up together; keeps texts with very many matches linear


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _matches(text: Column, pattern: str) -> Column:
    """(start, end, span) of all matches, in code points, in order of the text."""
    def length(pair: Column) -> Column:
        return F.char_length(pair["between"]) + F.char_length(pair["span"])

    def place(block: Column, start: Column) -> Column:
        def add(acc: Column, pair: Column) -> Column:
            begin = acc["at"] + F.char_length(pair["between"])
            end = begin + F.char_length(pair["span"])
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(
                begin.alias("start"), end.alias("end"), pair["span"].alias("span")))).alias("out"))
        return F.aggregate(block, F.struct(start.alias("at"), F.array().cast(_SPAN).alias("out")), add, lambda acc: acc["out"])

    def placed(pairs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(pairs) / _BLOCK).cast("int") - 1),
                             lambda b: F.slice(pairs, b * _BLOCK + 1, _BLOCK))

        def in_blocks(blocks: Column) -> Column:
            none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
            starts = F.aggregate(blocks, none, lambda acc, block: F.struct(
                F.aggregate(block, acc["at"], lambda n, p: n + length(p)).alias("at"),
                F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
            return F.flatten(F.zip_with(blocks, starts, place))
        return _let(blocks, in_blocks)

    # the i-th match starts after i + 1 stretches between matches and i matches
    pairs = F.filter(F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                                lambda b, s: F.struct(b.alias("between"), s.alias("span"))),
                     lambda p: p["span"].isNotNull())
    return F.when(text.rlike(pattern), _let(pairs, placed)).otherwise(F.array().cast(_SPAN))


def _vote(yes: Column, no: Column | None = None) -> Column:
    """'+' for, '-' against, '0' abstains."""
    out = F.when(yes, F.lit("+"))
    return (out.when(no, F.lit("-")) if no is not None else out).otherwise(F.lit("0"))


def _labelers(kind: str, span: Column, failed: Column, before: Column, after: Column, company: Column) -> list[Column]:
    """Votes on one span; ``failed``: it matches the base pattern but fails its check."""
    digits = _digits(span)
    domains = "|".join(TOP_DOMAINS)
    form = {
        "email": _vote(span.rlike(r"(?i)^[a-z0-9]")),
        "ip": _vote(~failed, failed),
        "card": _vote(~failed, failed),
        "phone": _vote(F.length(digits).between(9, 15), ~F.length(digits).between(7, 15)),
    }[kind]
    shape = {
        "email": _vote(span.rlike(r"(?i)[\[(](at|@)[\])]|[^\x20(\[]@"), span.rlike(r"(?i)\x20at\x20.*\.\x20")),
        "ip": _vote(span.rlike(r"^([0-9A-Fa-f]{1,4}:){7}|^([0-9]{1,3}\.){3}[0-9]{1,3}$"), span.rlike(r"(^|\.)0[0-9]|[0-9]{4}")),
        "card": _vote(span.rlike(r"^([0-9]{4}[^0-9]+){3}[0-9]{4}$|^[0-9]{15,16}$"), ~span.rlike(r"^[0-9]{13,19}$")),
        "phone": _vote(span.rlike(r"^(\+[0-9]{1,3}[\x20.-]?)?\([0-9]{3}\)|^\+"), span.rlike(r"^[0-9]+\.")),
    }[kind]
    gazetteer = {
        "email": _vote(span.rlike(rf"(?i)[^a-z]([a-z]{{2}}|{domains})$"), F.lit(True)),
        "ip": _vote(F.lit(False), span.rlike("^(0|127|255)[.]")),
        "card": _vote(span.rlike("^(4|5[1-5]|2[2-7]|3[47]|6011|65|35)"), F.lit(True)),
        "phone": _vote(span.rlike(r"^\+(1|7|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"), span.startswith("+")),
    }[kind]
    context = _vote(before.rlike(rf"(?i)(?<![\p{{L}}])({MARKS[kind]})[^\p{{L}}]{{0,8}}(\p{{L}}+[^\p{{L}}]{{1,3}}){{0,3}}$"))
    against = _vote(F.lit(False), before.rlike(r"(?i)[=#$/_\"'][\x20\"']*$|(version|v|id|no|isbn|doi|sha|order|ref)[\x20.:]*$")
                    | after.rlike(r"^[0-9A-Za-z_%/]"))
    return [form, shape, gazetteer, context, against, _vote(company)]


LABELERS = 6
WORD_BUCKETS = 64
_CODES = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/"


def _neighbour(char: Column) -> Column:
    """What kind of character stands beside a span."""
    return F.when(char == "", "e").when(char.rlike(r"^\s"), "s").when(char.rlike(r"^[\[({<\"']"), "o").when(
        char.rlike(r"^[0-9A-Za-z_]"), "a").when(char.rlike(r"^\p{L}"), "l").otherwise("p")


def _features(span: Column, before: Column, after: Column) -> Column:
    """One character a feature: digits, separators, first character, the characters beside it, the word before."""
    def code(number: Column) -> Column:
        return F.substr(F.lit(_CODES), number.cast("int") + 1, F.lit(1))
    joints = F.regexp_replace(span, "[0-9A-Za-z]", "")
    separators = F.when(joints == "", "n").when(joints.rlike(r"^[\x20]+$"), "s").when(joints.rlike("^-+$"), "d").when(
        joints.rlike(r"^[.]+$"), "t").when(joints.rlike("[(]"), "b").when(joints.rlike("@"), "m").otherwise("x")
    first = F.when(span.startswith("+"), "+").when(span.rlike("^[(]"), "(").when(span.rlike("^0"), "0").when(
        span.rlike("^[0-9]"), "9").otherwise("w")
    word = F.lower(F.regexp_extract(before, r"(\p{L}+)[^\p{L}]{0,12}$", 1))
    return F.concat(code(F.least(F.length(_digits(span)), F.lit(21))), separators, first,
                    _neighbour(F.right(before, F.lit(1))), _neighbour(F.left(after, F.lit(1))),
                    F.when(word == "", "-").otherwise(code(F.crc32(word.cast("binary")) % WORD_BUCKETS)))


FEATURES = 6


def _passing(kind: str) -> Column:
    return F.filter(f"__all_{kind}", lambda m: _valid(kind, m["span"]))


def _named(nth: int, kind: str) -> Column:
    return F.transform(f"__ok_{kind}", lambda m: F.struct(
        F.lit(nth).alias("nth"), m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind")))


_MORE = "array<struct<nth:int,start:int,end:int,kind:string,votes:string,features:string,veto:boolean>>"


def find(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``__base`` (spans that match and pass), ``__more`` (candidates) and ``__known`` (votes and features of base spans).

    Write the result and hand it to ``fit`` and ``detect`` where both are
    wanted: they look for spans only if these columns are not there.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("__body", body)
    for kind in KINDS:
        out = out.withColumn(f"__all_{kind}", _matches(F.col("__body"), BASE[kind]))
    for kind in KINDS:
        out = out.withColumn(f"__ok_{kind}", _passing(kind))
    out = out.withColumn("__base", F.array_sort(F.concat(*[_named(i, kind) for i, kind in enumerate(KINDS)])))

    def described(m: Column, i: int, kind: str) -> Column:
        before = F.substring(F.col("__body"), F.greatest(m["start"] - CONTEXT, F.lit(0)) + 1, F.least(m["start"], F.lit(CONTEXT)))
        after = F.substring(F.col("__body"), m["end"] + 1, F.lit(2))
        company = F.exists("__base", lambda b: (b["kind"] != kind) & (F.abs(b["start"] - m["end"]) < 1000))

        def seen(around: Column) -> Column:
            inside = around["before"].rlike("[0-9A-Za-z_]$") | around["after"].rlike("^[0-9A-Za-z_]")
            # a failed checksum or an octet out of range cannot be mended by other evidence
            failed = m["failed"] if kind in ("card", "ip") else F.lit(False)
            checked = F.lit(True) if kind != "card" else luhn(_digits(m["span"]))
            return F.struct(
                F.lit(i).alias("nth"), m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind"),
                F.concat(*_labelers(kind, m["span"], m["failed"], around["before"], around["after"], company)).alias("votes"),
                _features(m["span"], around["before"], around["after"]).alias("features"),
                (inside | failed | ~checked).alias("veto"))
        return _let(F.struct(before.alias("before"), after.alias("after")), seen)

    def spans_of(matches: Column, failed: bool) -> Column:
        return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"),
                                                       m["span"].alias("span"), F.lit(failed).alias("failed")))

    def candidates(kind: str, i: int) -> Column:
        plausible = {"card": (12, 20), "phone": (7, 18)}.get(kind, (0, 1 << 30))
        spans = spans_of(F.filter(f"__all_{kind}", lambda m: ~_valid(kind, m["span"]) & F.length(
            _digits(m["span"])).between(*plausible)), True)
        if kind in LOOSE:
            spans = F.concat(spans, spans_of(_matches(F.col("__body"), LOOSE[kind]), False))
        free = F.filter(spans, lambda m: ~F.exists("__base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
        return F.transform(free, lambda m: described(m, i, kind))

    for i, kind in enumerate(KINDS):
        out = out.withColumn(f"__known_{kind}", F.transform(
            spans_of(F.col(f"__ok_{kind}"), False), lambda m: described(m, i, kind)))
    none = F.array().cast(_MORE)
    loosely = F.col("__body").rlike(r"[0-9][0-9./_)\x20\x{A0}-]{2}|(?i)[(\[\x20](dot|\.)[)\]\x20]|:[0-9A-Fa-f]+:")
    for i, kind in enumerate(KINDS):
        out = out.withColumn(f"__more_{kind}", F.when(loosely, candidates(kind, i)).otherwise(none))
    return out.select(*[F.col(c) for c in df.columns], "__base",
                      F.concat(*[F.col(f"__more_{kind}") for kind in KINDS]).alias("__more"),
                      F.concat(*[F.col(f"__known_{kind}") for kind in KINDS]).alias("__known"))


def _found(docs: DataFrame, text: str) -> DataFrame:
    return docs if {"__base", "__more", "__known"} <= set(docs.columns) else find(docs, text)


Counts = dict[tuple[str, str], float]  # (votes, what is known: '1', '0' or '') -> spans


def reliabilities(counts: Counts) -> tuple[dict[str, float], list[dict[str, list[float]]], float]:
    """Anchored expectation-maximisation: posterior of each vote pattern, P(vote | truth) of each labeler, prior.

    Spans whose truth is known keep it.  Those known to be personal data weigh
    as much as all others together at most, so that they anchor the classes
    and do not drown them.  Vote tables are smoothed by one count; a labeler
    whose vote speaks for the wrong class is put at chance.
    """
    open_mass = sum(n for (_, known), n in counts.items() if known != "1")
    sure_mass = sum(n for (_, known), n in counts.items() if known == "1")
    scale = min(1.0, max(open_mass, 1.0) / sure_mass) if sure_mass else 1.0
    weights = {key: n * (scale if key[1] == "1" else 1.0) for key, n in counts.items()}
    belief = {p: 1 / (1 + math.exp(-sum((v == "+") - (v == "-") for v in p) + 0.5)) for p, _ in counts}
    tables: list[dict[str, list[float]]] = []
    prior = 0.5
    for _ in range(EM_ROUNDS):
        mass = [0.0, 0.0]
        raw = [{v: [1.0, 1.0] for v in "+0-"} for _ in range(LABELERS)]
        for (p, known), n in sorted(weights.items()):
            yes = float(known) if known else belief[p]
            for truth, share in ((0, 1 - yes), (1, yes)):
                mass[truth] += n * share
                for i in range(LABELERS):
                    raw[i][p[i]][truth] += n * share
        prior = (mass[1] + 1) / (mass[0] + mass[1] + 2)
        tables = [_no_worse_than_chance({v: [c[0] / (mass[0] + 3), c[1] / (mass[1] + 3)] for v, c in t.items()}) for t in raw]
        fresh = {}
        for p in belief:
            odds = math.log(prior / (1 - prior)) + sum(math.log(tables[i][p[i]][1] / tables[i][p[i]][0]) for i in range(LABELERS))
            fresh[p] = _sigmoid(odds)
        moved = max((abs(fresh[p] - belief[p]) for p in belief), default=0.0)
        belief = fresh
        if moved < 1e-9:
            break
    return belief, tables, prior


def _sigmoid(odds: float) -> float:
    return 1 / (1 + math.exp(-max(min(odds, 30.0), -30.0)))


def _no_worse_than_chance(table: dict[str, list[float]]) -> dict[str, list[float]]:
    out = {v: list(c) for v, c in table.items()}
    for vote, truth in (("+", 1), ("-", 0)):
        if out[vote][truth] < out[vote][1 - truth]:
            out[vote] = [sum(out[vote]) / 2] * 2
    for truth in (0, 1):
        out["0"][truth] = max(1 - out["+"][truth] - out["-"][truth], 1e-6)
        total = sum(out[v][truth] for v in "+0-")
        for v in "+0-":
            out[v][truth] /= total
    return out


def classify(counts: Counts, features: dict[tuple[str, str, int, str], float]) -> dict:
    """The model of one kind: posteriors of vote patterns, and a naive Bayes classifier trained on them.

    ``features`` has counts by (votes, what is known, feature, value).  The
    classifier's prior is that of the spans whose truth is open; base spans
    count as in ``reliabilities``.
    """
    belief, _, _ = reliabilities(counts)
    open_mass = sum(n for (_, known), n in counts.items() if known != "1")
    sure_mass = sum(n for (_, known), n in counts.items() if known == "1")
    scale = min(1.0, max(open_mass, 1.0) / sure_mass) if sure_mass else 1.0
    tables: list[dict[str, list[float]]] = [{} for _ in range(FEATURES)]
    for (votes, known, feature, value), n in sorted(features.items()):
        yes = float(known) if known else belief[votes]
        cell = tables[feature].setdefault(value, [0.0, 0.0])
        weight = n * (scale if known == "1" else 1.0)
        cell[0] += weight * (1 - yes)
        cell[1] += weight * yes
    mass = [1.0, 1.0]
    for (votes, known), n in counts.items():
        yes = float(known) if known else belief[votes]
        weight = n * (scale if known == "1" else 1.0)
        mass[0] += weight * (1 - yes)
        mass[1] += weight * yes
    logs = {}
    for i, table in enumerate(tables):
        totals = [sum(c[t] for c in table.values()) + len(table) + 1 for t in (0, 1)]
        for value, cell in table.items():
            logs[f"{i}{value}"] = math.log((cell[1] + 1) / totals[1]) - math.log((cell[0] + 1) / totals[0])
    return {"belief": belief, "prior": math.log(mass[1] / mass[0]), "features": logs}


Model = dict[str, dict]


def fit(docs: DataFrame, text: str = "text") -> Model:
    """The model of each kind, learned from all texts."""
    spans = F.concat(
        F.transform("__more", lambda m: F.struct(m["kind"].alias("kind"), m["votes"].alias("votes"), m["features"].alias("features"),
                                                 F.when(m["veto"], "0").otherwise("").alias("known"))),
        # a base span inside a longer token stays one, but is no example
        F.transform(F.filter("__known", lambda m: ~m["veto"]), lambda m: F.struct(
            m["kind"].alias("kind"), m["votes"].alias("votes"), m["features"].alias("features"), F.lit("1").alias("known"))))
    each = _found(docs, text).select(F.explode(spans).alias("s")).select("s.*")
    cells = F.concat(F.array(F.struct(F.lit(-1).alias("feature"), F.lit("").alias("value"))), F.transform(
        F.sequence(F.lit(0), F.lit(FEATURES - 1)),
        lambda i: F.struct(i.alias("feature"), F.substring("features", i + 1, F.lit(1)).alias("value"))))
    counted = each.select("kind", "votes", "known", F.explode(cells).alias("c")).groupBy(
        "kind", "votes", "known", "c.feature", "c.value").count().collect()
    model = {}
    for kind in KINDS:
        mine = [r for r in counted if r["kind"] == kind]
        model[kind] = classify({(r["votes"], r["known"]): float(r["count"]) for r in mine if r["feature"] < 0},
                               {(r["votes"], r["known"], r["feature"], r["value"]): float(r["count"]) for r in mine if r["feature"] >= 0})
    return model


def detect(docs: DataFrame, model: Model, text: str = "text", spans: str = "spans",
           threshold: float = THRESHOLD) -> DataFrame:
    """Add the spans of each text: kind, start, end (code points, end exclusive) and whether it is a base span.

    Sorted by kind as in ``KINDS``, then start.  Added spans never overlap base
    spans, nor each other (the earliest, then longest stays).  A candidate
    without one vote for it is never added.  NULL and empty texts have none.
    Rows are independent; equal texts have equal spans.
    """
    columns = [c for c in docs.columns if c not in ("__base", "__more", "__known")]
    if spans.lower() in {c.lower() for c in columns}:
        raise ValueError(f"column exists already: {spans}")
    accepted = [f"{kind}:{votes}" for kind in KINDS for votes, p in sorted(model[kind]["belief"].items())
                if p >= threshold and "+" in votes]
    logs = {f"{kind}{key}": v for kind in KINDS for key, v in sorted(model[kind]["features"].items())}
    logs |= {kind: model[kind]["prior"] for kind in KINDS}
    table = F.create_map(*[F.lit(x) for item in logs.items() for x in item])
    limit = math.log(threshold / (1 - threshold))

    def odds(m: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(FEATURES - 1)), F.element_at(table, m["kind"]), lambda acc, i: acc + F.coalesce(
            F.try_element_at(table, F.concat(m["kind"], i.cast("string"), F.substring(m["features"], i + 1, F.lit(1)))), F.lit(0.0)))

    found = _found(docs, text)
    kept = F.filter("__more", lambda m: ~m["veto"] & (F.concat(m["kind"], F.lit(":"), m["votes"]).isin(accepted)
                                                      if accepted else F.lit(False)) & (odds(m) >= limit))
    ordered = F.array_sort(F.transform(kept, lambda m: F.struct(
        m["start"].alias("start"), (-m["end"]).alias("back"), m["nth"].alias("nth"), m["kind"].alias("kind"))))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<nth:int,start:int,end:int,kind:string,base:boolean>>").alias("out"))
    added = F.aggregate(ordered, none, lambda acc, m: F.when(m["start"] >= acc["at"], F.struct(
        (-m["back"]).alias("at"), F.concat(acc["out"], F.array(F.struct(
            m["nth"].alias("nth"), m["start"].alias("start"), (-m["back"]).alias("end"), m["kind"].alias("kind"),
            F.lit(False).alias("base")))).alias("out"))).otherwise(acc), lambda acc: acc["out"])
    base = F.transform("__base", lambda b: F.struct(b["nth"].alias("nth"), b["start"].alias("start"), b["end"].alias("end"),
                                                    b["kind"].alias("kind"), F.lit(True).alias("base")))
    return found.withColumn(spans, F.array_sort(F.concat(base, added))).select(*[F.col(c) for c in columns], spans)


def count_base(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["base"] & (s["kind"] == kind))).cast("bigint")


def digest(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def redact(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Replace each span by its kind in angle brackets; overlapping spans become one, named by the first."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        piece = F.concat(F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))).otherwise(
            F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    def finish(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(F.col(text), acc["at"] + 1, F.char_length(text)))

    return docs.withColumn(text, F.when(F.size(spans) > 0, F.aggregate(ordered, none, add, finish)).otherwise(F.col(text))).drop(spans)
