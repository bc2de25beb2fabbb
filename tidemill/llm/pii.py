"""Personal data by weak supervision: labelers vote on candidate spans, a span classifier learns from the votes."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import written

#: Kinds with base spans, and those that only the method finds.
KINDS = ("email", "ip", "card", "phone")
ADDED = ("iban", "national_id", "secret", "name")
ALL = KINDS + ADDED

# What the base spans of each kind match, leftmost and not overlapping. Each pattern starts only
# where a match can and never gives back, so a long run is read once.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}(?![\x20-]?[0-9])"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Looser forms and further kinds, of which the votes have to decide.
_LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[({]\x20?at\x20?[\])}]\x20?[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[({]\x20?dot\x20?[\])}]\x20?)[A-Za-z0-9-]{1,63}+){1,8}+",
    "card": _CARD,
    "phone": r"(?<![0-9A-Za-z.+-])(?:\+[0-9]{1,2}\x20)?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3}+)?(?![0-9A-Za-z])",
    "national_id": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "secret": r"(?<![A-Za-z0-9_/+.=-])(?=[A-Za-z_/+-]*+[0-9])[A-Za-z0-9_/+-]{20,}+",
    "name": r"(?=\p{Lu})(?<=(?:\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sra)\.?|Madame|Monsieur|Señora?|name is|heiße|appelle|llamo)\x20)\p{Lu}\p{L}{1,30}+(?:\x20\p{Lu}\p{L}{1,30}+){0,2}+",
}
#: What a text has to have for a pattern to be tried at all.
_DIGIT = "[0-9]"
_GATES = {"email": r"[\[({]\x20?at\x20?[\])}]"}
_WITH_DIGITS = ("card", "phone", "iban", "national_id", "secret")
_BEFORE = 32

# Gazetteers and context words.
_DOMAINS = "com org net edu gov int info biz io co app dev de fr es uk eu ch at us ca it nl be pl se no dk fi pt br mx ar in jp au example".split()
_ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35)"
_COUNTRIES = "AT BE CH CZ DE DK ES FI FR GB GR HU IE IT LU NL NO PL PT RO SE SI SK".split()
_CALLING = r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
_KEYS = r"^(?:akia|asia|ghp_|gho_|sk-|pk_|xox[bp]-|aiza|eyj|glpat-)"
_GIVEN = "anna ana maria marie mary john jean juan jose josé peter paul pedro thomas michael michel miguel david daniel laura lucia sophie julia jane james robert elena carlos luis hans klaus pierre".split()
_CONTEXT = {
    "email": "email e-mail mail courriel correo write contact schreiben",
    "ip": "ip host server address adresse client addr from login",
    "card": "card visa mastercard amex credit debit karte carte tarjeta payment",
    "phone": "phone tel telephone call mobile cell fax telefon téléphone teléfono appeler llamar anrufen",
    "iban": "iban account konto compte cuenta bank",
    "national_id": "ssn social security id insurance steuer",
    "secret": "token secret key apikey api_key password passwd pwd credential bearer auth",
    "name": "mr mrs ms dr herr frau mme sra name heiße appelle llamo madame monsieur señor señora",
}
_AGAINST = {
    "secret": "sha sha1 sha256 md5 commit hash checksum digest revision integrity build",
    "": "isbn issn order invoice serial version sku article no. nr. ref doi token key hash build",
}


@dataclass(frozen=True)
class Labeler:
    """Votes 1 (personal), 0 (not) or nothing on a candidate ``c`` (struct kind, text, before)."""

    name: str

    def vote(self, c: Column) -> Column:
        kind, text, before = c["kind"], F.lower(c["text"]), F.lower(c["before"])
        digits = F.regexp_replace(text, "[^0-9]", "")
        national = text.rlike(r"^(?:\+[0-9]{1,2} )?\(?[2-9][0-9]{2}\)?[ .-][2-9]")
        if self.name == "form":
            strict = F.when(kind == "email", text.rlike(r"@|[\[({]")).when(kind == "card", digits == text).when(kind == "phone", text.rlike(r"^(?:\+|\(?[2-9])"))
            return strict.when(kind == "secret", text.rlike("[a-z]") & text.rlike("[0-9][a-z_/+-]*[0-9]")).when(kind == "name", c["text"].contains(" ")).otherwise(F.lit(True)).cast("int")
        if self.name == "checksum":
            own = F.when(kind == "card", luhn(digits).cast("int")).when(kind == "phone", F.when(text.startswith("+"), F.length(digits).between(9, 15)).otherwise(national).cast("int"))
            own = own.when(kind == "iban", mod97(c["text"]).cast("int")).when(kind == "ip", (~text.rlike(r"^(?:0|127|255)\.")).cast("int"))
            return own.when(kind == "national_id", (~text.rlike("^(?:000|666|9)|-00-|-0000$")).cast("int"))
        if self.name == "gazetteer":
            last = F.regexp_extract(text, r"([a-z0-9-]+)$", 1)
            own = F.when(kind == "email", last.isin(_DOMAINS).cast("int")).when(kind == "card", digits.rlike(_ISSUERS).cast("int")).when((kind == "phone") & text.startswith("+"), text.rlike(_CALLING).cast("int"))
            own = own.when(kind == "iban", F.substring(c["text"], 1, 2).isin(_COUNTRIES).cast("int")).when((kind == "secret") & text.rlike(_KEYS), F.lit(1))
            return own.when((kind == "name") & F.regexp_extract(text, r"^(\p{L}+)", 1).isin(_GIVEN), F.lit(1))
        if self.name == "variety":  # how many different signs: few in placeholders, many in what was drawn at random
            signs = F.size(F.array_distinct(F.split(F.when(kind == "secret", text).otherwise(digits), "")))
            return F.when(kind == "secret", (signs >= 10).cast("int")).when(kind.isin("card", "phone", "iban", "national_id"), (signs >= 4).cast("int"))
        if self.name == "against":
            words = lambda k: "|".join(w.replace(".", r"\.") for w in _AGAINST[k].split())
            said = lambda k: before.rlike(rf"(?:^|[^a-z])(?:{words(k)})[^a-z0-9]{{0,4}}$")
            return F.when(F.when(kind == "secret", said("secret")).otherwise(said("")), F.lit(0))
        own = F.lit(False)
        for k, w in _CONTEXT.items():
            own = own | ((kind == k) & before.rlike(rf"(?:^|[^\p{{L}}])(?:{'|'.join(w.split())})[^\p{{L}}]"))
        return F.when(own, F.lit(1))


LABELERS = tuple(Labeler(n) for n in ("form", "checksum", "gazetteer", "context", "variety", "against"))

#: Marks of a span and its surroundings that the classifier sees besides the votes.
_SHAPES = ("long", "assigned", "after_colon", "line_start")


def _shape(name: str, c: Column) -> Column:
    before = c["before"]
    if name == "long":
        return F.length(c["text"]) >= 20
    return before.rlike({"assigned": r"[=:]\x20?[\"']?$", "after_colon": r":\x20?$", "line_start": r"(?:^|\n)$"}[name])


def luhn(digits: Column) -> Column:
    """Whether the digits of a string pass the Luhn check."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = 2 * d
        return F.when((n - i) % 2 == 1, doubled - F.when(doubled > 9, 9).otherwise(0)).otherwise(d)

    return F.when(n == 0, F.lit(False)).otherwise(F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + value(i)) % 10 == 0)


def mod97(text: Column) -> Column:
    """Whether an IBAN passes its check: rearranged, with letters as numbers, the remainder by 97 is 1."""
    plain = F.replace(text, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))
    signs = F.filter(F.split(turned, ""), lambda x: x != "")
    value = lambda x: F.when(x.rlike("[0-9]"), x.cast("int")).otherwise(F.ascii(x) - 55)
    return F.aggregate(signs, F.lit(0), lambda s, x: (s * F.when(value(x) > 9, 100).otherwise(10) + value(x)) % 97) == 1


_FOUND = "array<struct<start:int,order:int,end:int,kind:string,base:boolean,text:string,before:string>>"
_SPAN = "array<struct<start:int,end:int,text:string,before:string>>"
_RUN = 64


def regex_spans(text: Column, pattern: str, gate: Column | None = None) -> Column:
    """Matches of ``pattern`` in a text, as structs (start, end, text, before) in code points.

    ``before`` is the few characters ahead of the match. The texts between matches give the positions: within runs of
    ``_RUN`` matches they are added up one by one, then each run moves by where it begins, so the work grows about
    in proportion to the matches. A text for which ``gate`` fails, or without a match, is only searched once.
    """
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def add(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        before = F.substring(pair["gap"], -_BEFORE, _BEFORE)
        span = F.struct(start.alias("start"), end.alias("end"), pair["hit"].alias("text"), before.alias("before"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    def joined(runs: Column) -> Column:
        begin = F.aggregate(runs, F.array(F.lit(0)), lambda s, r: F.concat(s, F.array(F.element_at(s, -1) + r["at"])))
        move = lambda r, by: F.transform(r["out"], lambda x: F.struct((x["start"] + by).alias("start"), (x["end"] + by).alias("end"), x["text"].alias("text"), x["before"].alias("before")))
        return F.flatten(F.zip_with(runs, F.slice(begin, F.lit(1), F.size(runs)), move))

    def found(pairs: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / _RUN).cast("int")), lambda k: F.aggregate(F.slice(pairs, k * _RUN + 1, F.lit(_RUN)), zero, add))
        many = F.get(F.transform(F.array(runs), joined), F.lit(0))
        return F.when(F.size(pairs) <= _RUN, F.aggregate(pairs, zero, add, lambda s: s["out"])).otherwise(many)

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits))
    pairs = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    has = text.rlike(pattern) if gate is None else gate & text.rlike(pattern)
    return F.when(has, F.get(F.transform(F.array(pairs), found), F.lit(0))).otherwise(zero["out"])


def base_spans(text: Column) -> dict[str, Column]:
    """The base spans of each kind, as ``regex_spans``."""
    digits = lambda s: F.length(F.regexp_replace(s["text"], "[^0-9]", ""))
    small = lambda s: F.forall(F.split(s["text"], r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    return {
        "email": regex_spans(text, _EMAIL, text.contains("@")),
        "ip": F.filter(regex_spans(text, _IP, text.contains(".") & text.rlike(_DIGIT)), small),
        "card": F.filter(regex_spans(text, _CARD, text.rlike(_DIGIT)), lambda s: luhn(F.regexp_replace(s["text"], "[^0-9]", ""))),
        "phone": F.filter(regex_spans(text, _PHONE, text.contains("+")), lambda s: digits(s).between(9, 15)),
    }


def _of_kind(spans: Column, kind: str, base: bool) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(ALL.index(kind)).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(base).alias("base"), s["text"].alias("text"), s["before"].alias("before")))


def _free(spans: Column, taken: Column) -> Column:
    """``spans`` that overlap none of ``taken``, which are looked up in runs of neighbours."""

    def by_run(places: Column) -> Column:
        def run(k: Column) -> Column:
            own = F.slice(places, k * _RUN + 1, F.lit(_RUN))
            return F.struct(F.element_at(own, 1)["start"].alias("lo"), F.array_max(F.transform(own, lambda x: x["end"])).alias("hi"), own.alias("own"))

        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(places) - 1) / _RUN).cast("int")), run)
        meets = lambda c, t: (t["start"] < c["end"]) & (c["start"] < t["end"])
        clear = lambda runs: F.filter(spans, lambda c: ~F.exists(runs, lambda r: (r["lo"] < c["end"]) & (c["start"] < r["hi"]) & F.exists(r["own"], lambda t: meets(c, t))))
        return F.get(F.transform(F.array(runs), clear), F.lit(0))

    places = F.sort_array(F.transform(taken, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"))))
    return F.when((F.size(taken) == 0) | (F.size(spans) == 0), spans).otherwise(F.get(F.transform(F.array(places), by_run), F.lit(0)))


def _loose(text: Column) -> Column:
    """Spans of the looser forms and further kinds."""
    of = lambda k: _of_kind(regex_spans(text, _LOOSE[k], text.rlike(_GATES[k]) if k in _GATES else None), k, False)
    digits = F.concat(*[of(k) for k in _WITH_DIGITS])
    return F.concat(F.when(text.rlike(_DIGIT), digits).otherwise(F.array().cast(_FOUND)), *[of(k) for k in _LOOSE if k not in _WITH_DIGITS])


def _voted(c: Column) -> Column:
    fields = [c[n].alias(n) for n in ("start", "order", "end", "kind", "base", "text")]
    return F.struct(*fields, *[x.vote(c).alias(x.name) for x in LABELERS], *[_shape(n, c).cast("int").alias(n) for n in _SHAPES])


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


#: How often a labeler votes 1 and 0 on personal and on other spans, to begin with; of two of them silence says something too.
_RATES = {
    "form": ((0.90, 0.10), (0.50, 0.50)),
    "checksum": ((0.95, 0.05), (0.40, 0.60)),
    "gazetteer": ((0.90, 0.10), (0.30, 0.70)),
    "context": ((0.50, 0.01, 0.49), (0.05, 0.01, 0.94)),
    "variety": ((0.95, 0.05), (0.65, 0.35)),
    "against": ((0.01, 0.01, 0.98), (0.01, 0.30, 0.69)),
}
#: Share of personal spans among loose candidates of a kind, to begin with.
_SHARES = {"email": 0.5, "iban": 0.5, "name": 0.3}


def fit_reliabilities(patterns: list[tuple[str, bool, tuple[int | None, ...], int]], rates: list[tuple], rounds: int = 50, strength: float = 20.0, drift: float = 3.0) -> list[float]:
    """The posterior of each vote pattern (kind, base, votes, count), by expectation-maximisation.

    Every labeler has a rate of each vote on personal and on other spans, and each kind its share of personal spans
    among loose candidates, all starting from what is given with ``strength`` pseudo-counts. Base spans are
    personal. A labeler was written to tell the two apart: the ratio of its rates moves by a factor of ``drift`` at
    most from where it began, so that labelers that often agree can't turn another one round. The patterns are a
    bounded table, however many spans there are.
    """
    place = {1: 0, 0: 1, None: 2}
    ratio = [[math.log(yes / no) for yes, no in zip(*r)] for r in rates]
    begin = [list(r) for r in ratio]
    share = {k: _SHARES.get(k, 0.2) for k, *_ in patterns}
    prior, post = dict(share), [1.0] * len(patterns)
    for _ in range(rounds):
        for i, (kind, base, votes, _) in enumerate(patterns):
            if not base:
                post[i] = _sigmoid(math.log(share[kind] / (1 - share[kind])) + sum(ratio[j][place[v]] for j, v in enumerate(votes) if place[v] < len(ratio[j])))
        for k in share:
            own = [(p, n) for p, (kind, base, _, n) in zip(post, patterns) if kind == k and not base]
            total = sum(n for _, n in own)
            share[k] = min(0.8, max(0.02, (sum(p * n for p, n in own) + strength * prior[k]) / (total + strength)))
        for j, r in enumerate(rates):
            sums = [[strength * x for x in side] for side in r]
            for p, (_, _, votes, n) in zip(post, patterns):
                if place[votes[j]] >= len(r[0]):
                    continue
                sums[0][place[votes[j]]] += p * n
                sums[1][place[votes[j]]] += (1 - p) * n
            for v in range(len(r[0])):
                now = math.log(sums[0][v] / sum(sums[0])) - math.log(sums[1][v] / sum(sums[1]))
                at = begin[j][v]
                low, high = at - math.log(drift), at + math.log(drift)
                low, high = (max(low, 0.0), high) if at > 0 else (low, min(high, 0.0))
                ratio[j][v] = min(high, max(low, now))
    return post


def fit_classifier(rows: list[tuple[tuple[float, ...], float, int]], rounds: int = 30, ridge: float = 0.1) -> list[float]:
    """Weights of a logistic regression on (features, target probability, count), by Newton steps; rows weigh the root of their count. The first feature is 1."""
    if not rows:
        return []
    x, y, n = np.array([f for f, _, _ in rows]), np.array([t for _, t, _ in rows]), np.sqrt([c for _, _, c in rows])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        slope = x.T @ (n * (p - y)) + ridge * w
        bend = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step * min(1.0, 4.0 / max(1e-9, float(np.abs(step).max())))
    return w.tolist()


def _features(kind: str, votes: tuple[int | None, ...], shapes: tuple[int, ...]) -> tuple[float, ...]:
    """1, a mark of the kind, for each labeler and kind of vote a mark, the shapes."""
    return (1.0, *[float(kind == k) for k in ALL[1:]], *[float(v == x) for v in votes for x in (1, 0)], *map(float, shapes))


def _logit(c: Column, w: list[float]) -> Column:
    x = F.lit(w[0])
    for k, a in zip(ALL[1:], w[1:]):
        x = x + F.when(c["kind"] == k, F.lit(a)).otherwise(F.lit(0.0))
    at = len(ALL)
    for labeler in LABELERS:
        v = c[labeler.name]
        x = x + F.when(v == 1, F.lit(w[at])).when(v == 0, F.lit(w[at + 1])).otherwise(F.lit(0.0))
        at += 2
    for name, a in zip(_SHAPES, w[at:]):
        x = x + c[name] * F.lit(a)
    return x


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: id and ``spans``, structs (start, order, end, kind, base, text, probability), sorted.

    Base spans are e-mail addresses, IPv4 addresses, card numbers and international phone numbers of the strict
    forms above; they always stay. They and looser candidates (obfuscated addresses, national phone numbers,
    card-like numbers, IBANs, national ids, secrets, names after a title) get votes of pattern, checksum, gazetteer,
    context and variety labelers, in one pass that is written. From it the patterns of votes, a bounded table, are
    counted over all spans; expectation-maximisation estimates how reliable each labeler is, and a logistic
    regression on votes, kind and shape, trained on its posteriors, is one more expression over the written spans:
    it adds those of probability ``threshold`` and more. Of added spans that overlap, the earlier kind stays.
    Everything on rows is built-in functions; the driver sees pattern counts only.

    Null texts are empty and have no spans. The time for a text grows with its length and its spans. Ids are passed
    on, null or repeated; other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = base_spans(F.col("_text"))
    read = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    read = read.select("_id", "_text", F.concat(*[_of_kind(base[k], k, True) for k in KINDS]).alias("_base"), _loose(F.col("_text")).alias("_more"))
    read = read.select("_id", F.transform(F.concat("_base", _free(F.col("_more"), F.col("_base"))), _voted).alias("_c"))
    read = written(read, "votes")
    votes, shapes = [x.name for x in LABELERS], list(_SHAPES)
    patterns = read.select(F.inline("_c")).groupBy("kind", "base", *votes, *shapes).count()
    n = len(votes) + 2
    table = sorted(((r[0], r[1], tuple(r[2:n]), r[-1], tuple(r[n:-1])) for r in patterns.collect()), key=lambda r: (r[0], r[1], [-1 if v is None else v for v in r[2]], r[4]))
    post = fit_reliabilities([r[:4] for r in table], [_RATES[x.name] for x in LABELERS])
    w = fit_classifier([(_features(k, v, s), p, n) for (k, _, v, n, s), p in zip(table, post)]) or [0.0] * (len(ALL) + 2 * len(votes) + len(shapes))
    chance = lambda c: 1 / (1 + F.exp(-_logit(c, w)))
    rated = F.transform("_c", lambda c: F.struct(*[c[f].alias(f) for f in ("start", "order", "end", "kind", "base", "text")], chance(c).alias("probability")))
    rated = read.select("_id", F.sort_array(F.filter(rated, lambda c: c["base"] | (c["probability"] >= threshold))).alias("_c"))
    # of added spans that overlap the one before or after, the earlier kind stays
    clash = lambda a, b: ~a["base"] & ~b["base"] & (b["start"] < a["end"]) & (a["start"] < b["end"])
    beaten = lambda c, o: F.coalesce(clash(c, o) & (o["order"] < c["order"]), F.lit(False))
    clear = F.filter("_c", lambda c, i: ~(beaten(c, F.get("_c", i - 1)) | beaten(c, F.get("_c", i + 1))))
    return rated.select(F.col("_id").alias(id_col), clear.alias("spans"))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
