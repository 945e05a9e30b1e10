"""PII: candidate gradient boosting, on DataFrame and SQL functions only.

*Base rules* find e-mail addresses, IPv4 addresses, payment cards and phone
numbers; their spans always stay.  *Generators* of high recall propose
further, overlapping spans: looser forms of the same four kinds, among them
spelled-out and bracketed signs, IPv6, cards of 12 digits on, numbers without
a plus.  Every candidate becomes a vector of small integers about its form and
context.

What the trees learn is not the base rules.  Every base span that stands by
itself is rewritten, in its own context and in none, in forms that the base rules do not match (``name [at] host
[dot] com``, ``(555) 010-9999``, ``10[.]0[.]0[.]1``, a card of 15 digits with
its check digit ...): their candidates are the positives, whose truth is known.
Of the corpus's own candidates outside base spans, those that are no personal
data for sure (``sure_negative``) are the negatives; the others, which may be
what is sought, teach nothing, but take part in the calibration.  Boosted
depth-2 trees are fitted to the counts of each distinct vector: one grouped
aggregation whose result is bounded by ``VECTOR_BOUND`` rows, whatever the
corpus.  One half of the documents and of the forms of rewriting fits the trees, the
other calibrates a threshold for each kind, so what is measured is how the trees
do on forms that they were not taught.  Candidates above it that touch no base span are
added.  The model is applied as a SQL expression.

Positions and contexts come from ``split`` and ``regexp_extract_all`` over the
same pattern: the lengths of the pieces and matches add up to code-point offsets.
Spans that touch are found by sorted sweeps, so a text of many spans costs what
they cost in many texts.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.common import materialize, table

KINDS = ["email", "ip", "card", "phone"]

# Base patterns.  They match what the plain forms match, but possessive
# repeats keep long texts from deep recursion, and the look-behinds keep runs
# of one class from being tried at each of their positions.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

# Generators: looser than the base rules.
LOOSE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:@| ?[\[(]at[\])] ?)[A-Za-z0-9-]++(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9]{1,4}(?:\[?\.\]?[0-9]{1,4}){2,5}|(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4})",
    "card": r"(?<![0-9])[0-9](?:[ ./-]{0,3}+[0-9])++",
    "phone": r"(?<![0-9])\+?\(?[0-9]{1,4}\)?(?:[ ./-]\(?[0-9]{2,6}\)?){1,5}",
}
_GUARD = {"email": r"@|[\[(]at[\])]", "ip": r"[0-9A-Fa-f](?:\[?\.|:)[0-9A-Fa-f\]]", "card": "[0-9]", "phone": "[0-9]"}
#: A candidate of fewer digits is none.
_DIGITS_LEAST = {"email": 0, "ip": 0, "card": 12, "phone": 7}

#: Features and the number of values that each can take.
FEATURES = {"kind": 4, "digits": 8, "parts": 8, "plus": 2, "paren": 2, "luhn": 2, "form": 6, "before": 4, "after": 4, "cue": 3, "at": 4}
#: Those that a kind has; the others are 0.
OF_KIND = {"email": ("parts", "at"), "ip": ("digits", "parts", "form"), "card": ("digits", "parts", "luhn", "form"), "phone": ("digits", "parts", "plus", "paren", "form")}
EVERY_KIND = ("before", "after", "cue")
VECTOR_BOUND = sum(math.prod(FEATURES[f] for f in (*own, *EVERY_KIND)) for own in OF_KIND.values())
CUES = r"(?i)(?:mail|contact|phone|tel|call|fax|mobile|card|visa|pay|host|server|addr|\bip\b)"
OTHER_CUES = r"(?i)(?:order|invoice|version|section|chapter|isbn|\bsku\b|serial|\blot\b|\bpart\b|ticket|\bref\b|page|\bno\b)"
#: Characters of context before a span.
CONTEXT = 24
CHUNK = 256


#: What :func:`matches` returns: a span, its text, up to ``CONTEXT`` characters before it and two after.
_MATCHES = "array<struct<s:int,e:int,m:string,b:string,a:string>>"


def _once(value: Column, of) -> Column:
    """``of(value)`` with the value computed once, however often it is named."""
    return F.transform(F.array(value), of)[0]


def _swept(items: Column, start: Column, none: Column, step) -> Column:
    """What ``step(state, item)`` adds in one pass over an array, as the field ``out``; the last state is ``next``.

    A step gives the next state and an array to add, of the type of ``none``, which is empty.  What is
    added is gathered in chunks, so the work does not grow with the square of the items; nothing
    that grows is bound to a name inside, as that would copy it.
    """

    def one(acc: Column, x: Column) -> Column:
        state, out = step(acc["next"], x)
        return F.struct(state.alias("next"), F.concat(acc["out"], out).alias("out"))

    def chunk(acc: Column, some: Column) -> Column:
        return F.aggregate(some, F.struct(acc["next"].alias("next"), none.alias("out")), one, lambda a: F.struct(a["next"].alias("next"), F.concat(acc["out"], F.array(a["out"])).alias("out")))

    def over(every: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(every) / CHUNK).cast("int") - 1, F.lit(0))), lambda c: F.slice(every, c * CHUNK + 1, CHUNK))
        return F.aggregate(chunks, F.struct(start.alias("next"), F.slice(F.array(none), 1, 0).alias("out")), chunk, lambda a: F.struct(a["next"].alias("next"), F.flatten(a["out"]).alias("out")))

    return _once(items, over)


def matches(text: Column, pattern: str, guard: Column) -> Column:
    """``array<struct<s, e, m, b, a>>``: code-point span and text of every match, and what is around it.

    All of it is summed and cut from the pieces between the matches, so the work grows with
    the text and not with the matches times the text.
    """
    ends = lambda c, n: F.substring(c, -n, n)

    def placed(pieces: Column, found: Column) -> Column:
        after = F.zip_with(F.slice(pieces, 2, F.size(found)), F.slice(found, 2, F.greatest(F.size(found) - 1, F.lit(0))), lambda p, m: F.substring(F.concat(F.substring(p, 1, 2), F.coalesce(F.substring(m, 1, 2), F.lit(""))), 1, 2))
        items = F.zip_with(F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(p.alias("p"), m.alias("m"))), after, lambda x, a: F.struct(F.length(x["p"]).alias("g"), F.length(x["m"]).alias("n"), ends(x["p"], CONTEXT).alias("p"), x["m"].alias("m"), a.alias("a")))

        def step(state: Column, x: Column) -> tuple[Column, Column]:
            at = state["at"] + x["g"]
            before = ends(F.concat(state["tail"], x["p"]), CONTEXT)
            span = F.struct(at.alias("s"), (at + x["n"]).alias("e"), x["m"].alias("m"), before.alias("b"), x["a"].alias("a"))
            return F.struct((at + x["n"]).alias("at"), ends(F.concat(before, ends(x["m"], CONTEXT)), CONTEXT).alias("tail")), F.array(span)

        return _swept(items, F.struct(F.lit(0).alias("at"), F.lit("").alias("tail")), F.array().cast(_MATCHES), step)["out"]

    spans = _once(F.split(text, pattern, -1), lambda pieces: _once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: placed(pieces, found)))
    return F.when(guard & text.rlike(pattern), spans).otherwise(F.array().cast(_MATCHES))


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Does a string of digits pass the Luhn check?"""
    backwards = F.reverse(digits)

    def add(total, i):
        x = F.substring(backwards, i, F.lit(1)).cast("int")
        twice = F.when(x > 4, x * 2 - 9).otherwise(x * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    n = F.length(digits_of(m))
    if kind == "ip":
        return m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(n.between(16, 19), luhn(digits_of(m))).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(8, 15)
    return F.lit(True)


def _valid_of(kind: str):
    return lambda x: _valid(kind, x["m"])


def _spans(matched: Column) -> Column:
    return F.transform(matched, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))


def _side(c: Column) -> Column:
    """Class of a neighbouring character: 0 none or space, 1 letter, 2 digit, 3 other."""
    return F.when((c == "") | c.rlike(r"^\s$"), 0).when(c.rlike(r"^\p{L}$"), 1).when(c.rlike("^[0-9]$"), 2).otherwise(3)


def _candidate(k: int, x: Column) -> Column:
    m, s, e = x["m"], x["s"], x["e"]
    kind = KINDS[k]
    digits = digits_of(m)
    n = F.length(digits)
    plain = F.regexp_replace(m, r"[\[\]]", "")
    octets = plain.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    sign = F.when(m.rlike(r"[\[(](?:at|dot|\.)"), 5).when(m.contains("["), 5).when(m.contains(":"), 4)
    values = {
        "kind": F.lit(k),
        "digits": F.when(n < 4, 0).when(n < 8, 1).when(n < 10, 2).when(n < 12, 3).when(n < 15, 4).when(n < 16, 5).when(n < 20, 6).otherwise(7),
        "parts": F.least(F.size(F.split(m, "[^0-9A-Za-z]+", -1)) - 1, F.lit(7)),
        "plus": m.startswith("+").cast("int"), "paren": m.contains("(").cast("int"),
        "luhn": F.when(n.between(12, 19), luhn(digits)).otherwise(F.lit(False)).cast("int"),
        "form": sign.when(octets, 1).otherwise(0) if kind == "ip" else sign.when(m.contains("/"), 3).when(m.contains("."), 2).when(m.contains("-"), 1).otherwise(0),
        "before": _side(F.substring(x["b"], -1, 1)), "after": _side(F.substring(x["a"], 1, 1)),
        "cue": F.when(x["b"].rlike(CUES), 1).when(x["b"].rlike(OTHER_CUES), 2).otherwise(0),
        "at": F.when(m.rlike(r"@.*\."), 1).when(m.contains("@"), 0).when(m.rlike(r"[\[(]dot[\])]|\."), 2).otherwise(3),
    }
    own = ("kind", *OF_KIND[kind], *EVERY_KIND)
    return F.struct(s.alias("s"), e.alias("e"), *((values[f] if f in own else F.lit(0)).cast("int").alias(f) for f in FEATURES))


def _candidate_of(k: int):
    return lambda x: _candidate(k, x)


def candidates_of(text: Column, kind: str) -> Column:
    """The candidates of a kind, from what its generator matches."""
    least = _DIGITS_LEAST[kind]
    found = matches(text, LOOSE[kind], text.rlike(_GUARD[kind]))
    found = F.filter(found, lambda x: F.length(digits_of(x["m"])) >= least) if least else found
    return F.transform(found, _candidate_of(KINDS.index(kind)))


def _snippet_of(k: int):
    return lambda x: F.struct(F.lit(k).alias("kind"), x["b"].alias("before"), x["m"].alias("m"), x["a"].alias("after"))


def propose(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, email, ip, card, phone`` (base spans), ``candidates`` and ``snippets`` (base spans with context) for every row."""
    text = F.col("text")
    out = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = out.withColumn("digit", text.rlike("[0-9]"))
    for kind in KINDS:
        guard = text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else F.col("digit")
        out = out.withColumn(f"m_{kind}", F.filter(matches(text, BASE[kind], guard), _valid_of(kind)))
        out = out.withColumn(f"c_{kind}", candidates_of(text, kind))
    base = [_spans(F.col(f"m_{k}")).alias(k) for k in KINDS]
    snippets = F.concat(*(F.transform(f"m_{kind}", _snippet_of(k)) for k, kind in enumerate(KINDS)))
    return out.select("id", F.pmod(F.xxhash64("text"), F.lit(2)).alias("fold"), *base, F.concat(*(F.col(f"c_{k}") for k in KINDS)).alias("candidates"), snippets.alias("snippets"))


def rewritten(kind: str, m: Column) -> list[Column]:
    """Forms of a base span that the base rules do not match (null where a form does not apply).

    Those at even places teach the trees, the others calibrate and are measured."""
    d = digits_of(m)
    if kind == "email":
        local, host = F.regexp_extract(m, "^([^@]*)@", 1), F.regexp_extract(m, "@(.*)$", 1)
        spelled = lambda a, b: F.concat(local, F.lit(a), F.replace(host, F.lit("."), F.lit(b)))
        return [spelled(" [at] ", " [dot] "), spelled("(at)", "(dot)"), spelled(" [at] ", "."), spelled(" (at) ", " (dot) ")]
    if kind == "ip":
        part = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))
        pair = lambda i: F.lower(F.hex(part[i] * 256 + part[i + 1] + 4096))
        return [F.replace(m, F.lit("."), F.lit("[.]")), F.concat_ws(":", F.lit("fd00"), pair(0), pair(2), F.lit("0"), F.lit("0"), F.lit("0"), pair(0), pair(2)), F.concat_ws(":", F.lit("2001"), F.lit("db8"), pair(0), pair(2), pair(0), pair(2), F.lit("8a2e"), F.lit("1"))]
    if kind == "card":
        fours = lambda sign: F.regexp_replace(d, "([0-9]{4})(?=[0-9])", f"$1{sign}")
        head = F.substring(d, 1, 14)
        # the check digit of the fourteen that come before it
        total = F.aggregate(F.sequence(F.lit(1), F.lit(14)), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 1, F.substring(head, F.lit(15) - i, F.lit(1)).cast("int") * 2 - F.when(F.substring(head, F.lit(15) - i, F.lit(1)) > "4", 9).otherwise(0)).otherwise(F.substring(head, F.lit(15) - i, F.lit(1)).cast("int")))
        fifteen = F.concat(head, ((10 - total % 10) % 10).cast("string"))
        return [fours("."), fours(" - "), fifteen, F.regexp_replace(fifteen, "^([0-9]{4})([0-9]{6})([0-9]{5})$", "$1 $2 $3")]
    ten = F.when(F.length(d) >= 10, F.substring(d, -10, 10))
    split = lambda form: F.regexp_replace(ten, "^([0-9]{3})([0-9]{3})([0-9]{4})$", form)
    return [split("($1) $2-$3"), split("$1-$2-$3"), split("$1.$2.$3"), split("$1 $2 $3"), F.when(F.length(d).between(9, 11), F.concat(F.lit("00"), F.substring(d, 1, 2), F.lit(" "), F.substring(d, 3, 3), F.lit(" "), F.substring(d, 6, 6)))]


def sure_negative(x: Column) -> Column:
    """Is a candidate outside base spans no personal data for sure?  It is part of a longer run, follows
    a cue of something else, or lacks what its kind has: a check digit, octets or eight groups, a dotted
    host, a cue of a phone.  What is neither this nor a rewritten base span teaches nothing."""
    lacks = F.when(x["kind"] == 0, x["at"].isin(0, 3)).when(x["kind"] == 1, (x["form"] == 0) | (x["form"] == 4) & (x["parts"] < 7)).when(x["kind"] == 2, x["luhn"] == 0).otherwise(x["cue"] != 1)
    return x["before"].isin(1, 2) | x["after"].isin(1, 2) | (x["cue"] == 2) | lacks


def training_vectors(found: DataFrame, taught: int | None = None) -> DataFrame:
    """``fold``, the features and ``pos``: 1 for a rewritten base span, 0 for a candidate outside base spans.
    ``sure`` is 1, but for candidates that are neither (:func:`sure_negative`), which only fold 1 has.

    The folds share neither documents nor forms of rewriting.  Every base span is rewritten; with ``taught``, about so many, by hash."""
    outside = found.select("fold", F.explode(free_of(F.concat(*KINDS), F.col("candidates"))).alias("x")).withColumn("sure", sure_negative(F.col("x")).cast("int")).where("sure = 1 OR fold = 1")
    negatives = outside.select("fold", *(F.col(f"x.{f}").alias(f) for f in FEATURES), F.lit(0).cast("long").alias("pos"), "sure")
    forms = F.coalesce(*(F.when(F.col("x.kind") == k, F.array(*rewritten(kind, F.col("x.m")))) for k, kind in enumerate(KINDS)))
    # a base span within a longer run (digits of a hash, say) is no sure example
    apart = ~F.col("x.before").rlike("[A-Za-z0-9]$") & ~F.col("x.after").rlike("^[A-Za-z0-9]")
    told = found.select("fold", F.posexplode("snippets").alias("n", "x")).where(apart)
    if taught is not None and (spans := found.agg(F.sum(F.size("snippets"))).first()[0] or 0) > taught:
        told = told.where(F.pmod(F.xxhash64("n", "x"), F.lit(spans)) < taught)
    told = told.select("fold", "x.kind", "x.before", "x.after", F.posexplode(forms).alias("number", "form")).where("form IS NOT NULL AND number % 2 = fold")
    # taught in its own context and in none, so that the form counts for itself
    places = F.array(F.struct("before", "after"), F.struct(F.lit("").alias("before"), F.lit("").alias("after")))
    told = told.select("fold", "kind", "form", F.explode(places).alias("at")).select("fold", "kind", "form", "at.before", "at.after")
    told = told.select("fold", F.col("kind").alias("k"), F.concat("before", "form", "after").alias("text"), F.length("before").alias("from"), (F.length("before") + F.length("form")).alias("to"))
    candidates = F.coalesce(*(F.when(F.col("k") == k, candidates_of(F.col("text"), kind)) for k, kind in enumerate(KINDS)))
    told = told.select("fold", "from", "to", F.explode(candidates).alias("x")).where((F.col("x.s") <= F.col("from")) & (F.col("x.e") >= F.col("to")))
    return negatives.unionAll(told.select("fold", *(F.col(f"x.{f}").alias(f) for f in FEATURES), F.lit(1).cast("long").alias("pos"), F.lit(1).alias("sure")))


def free_of(spans: Column, xs: Column) -> Column:
    """Those of ``xs`` that touch none of ``spans``, by their ends: one sort and one sweep.  A span touches
    ``x`` if it begins before ``x`` ends and ends after ``x`` begins, so the furthest end of those that
    began is all that the sweep has to know."""

    def over(every: Column, none: Column, nothing: Column) -> Column:
        begun = F.transform(spans, lambda b: F.struct(b["s"].alias("at"), F.lit(1).alias("begins"), b["e"].alias("far"), nothing.alias("x")))
        asked = F.transform(every, lambda x: F.struct(x["e"].alias("at"), F.lit(0).alias("begins"), x["s"].alias("far"), x.alias("x")))

        def step(furthest: Column, item: Column) -> tuple[Column, Column]:
            out = F.when((item["begins"] == 0) & (furthest <= item["far"]), F.array(item["x"])).otherwise(none)
            return F.when(item["begins"] == 1, F.greatest(furthest, item["far"])).otherwise(furthest), out

        return _swept(F.array_sort(F.concat(begun, asked)), F.lit(0), none, step)["out"]

    def bound(every: Column) -> Column:
        return _once(F.slice(every, 1, 0), lambda none: _once(F.get(none, F.lit(0)), lambda nothing: over(every, none, nothing)))

    return _once(xs, lambda every: F.when((F.size(spans) > 0) & (F.size(every) > 0), bound(every)).otherwise(every))


def best_of(xs: Column) -> Column:
    """Those of ``xs`` (``kind, s, e, score``) that touch none that is ahead: of a higher score, or of the
    same and a kind before.  Spans of one kind do not touch each other, so in the order of their
    beginnings only the last of each other kind can touch the next."""
    ahead = lambda y, x: (y["score"] > x["score"]) | ((y["score"] == x["score"]) & (y["kind"] < x["kind"]))
    made = "array<struct<kind:int,s:int,e:int,score:double>>"
    slot = "struct<kind:int,s:int,e:int,score:double,beaten:boolean>"
    bare = lambda y: F.struct(*(y[c].alias(c) for c in ("kind", "s", "e", "score")))
    kept = lambda y: F.when(y.isNotNull() & ~y["beaten"], F.array(bare(y))).otherwise(F.array().cast(made))

    def step(last: Column, x: Column) -> tuple[Column, Column]:
        touches = lambda y: y.isNotNull() & (y["e"] > x["s"]) & (y["kind"] != x["kind"])
        beaten = F.exists(last, lambda y: touches(y) & ahead(y, x))
        own = F.struct(*(x[c].alias(c) for c in ("kind", "s", "e", "score")), beaten.alias("beaten"))
        others = F.transform(last, lambda y: F.when(touches(y), F.struct(*(y[c].alias(c) for c in ("kind", "s", "e", "score")), (y["beaten"] | ahead(x, y)).alias("beaten"))).otherwise(y))
        held = F.transform(others, lambda y, k: F.when(k == x["kind"], own).otherwise(y))
        return held, kept(F.get(last, x["kind"]))

    def over(every: Column) -> Column:
        in_order = F.array_sort(F.transform(every, lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("kind"), x["e"].alias("e"), x["score"].alias("score"))))
        swept = _swept(in_order, F.array_repeat(F.lit(None).cast(slot), len(KINDS)), F.array().cast(made), step)
        return _once(swept, lambda r: F.concat(r["out"], F.flatten(F.transform(r["next"], kept))))

    return _once(xs, lambda every: F.when(F.size(every) > 1, over(every)).otherwise(F.transform(every, bare)))


def fit_trees(rows: list[tuple[tuple[int, ...], float, float]], rounds: int = 24, rate: float = 0.4) -> list[tuple]:
    """Boosted depth-2 trees of logistic loss on ``(vector, positives, negatives)``.

    A tree is ``(feature, value, left, right)``, to the left where the feature
    is at most the value; a leaf is a number.
    """
    if not rows:
        return []
    names = list(FEATURES)
    tests = [(f, v) for f, n in enumerate(FEATURES.values()) for v in range(n - 1)]
    x, pos, neg = np.array([v for v, _, _ in rows]), np.array([p for _, p, _ in rows]), np.array([n for _, _, n in rows])
    left = np.array([x[:, f] <= v for f, v in tests], float)
    score = np.zeros(len(rows))

    def grow(here: np.ndarray, depth: int):
        g, h, n = (grad * here).sum(), (hess * here).sum(), here.sum()
        if depth:
            gl, hl, nl = left @ (grad * here), left @ (hess * here), left @ here
            gains = np.where((nl > 0) & (nl < n), gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1), -1.0)
            best = int(gains.argmax())
            if gains[best] > 1e-6:
                f, v = tests[best]
                return (names[f], v, grow(here * left[best], depth - 1), grow(here * (1 - left[best]), depth - 1))
        return float(rate * g / (h + 1))

    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        grad, hess = pos - (pos + neg) * p, (pos + neg) * p * (1 - p)
        tree = grow(np.ones(len(rows)), 2)
        if not isinstance(tree, tuple):
            break
        trees.append(tree)
        score = np.clip(score + [evaluate(tree, v) for v, _, _ in rows], -30.0, 30.0)
    return trees


def evaluate(tree, vector: tuple[int, ...]) -> float:
    names = list(FEATURES)
    while isinstance(tree, tuple):
        f, v, left, right = tree
        tree = left if vector[names.index(f)] <= v else right
    return tree


def calibrate(rows: list[tuple[tuple[int, ...], float, float]], trees: list[tuple], precision: float) -> dict[int, float]:
    """For each kind the middle between the least score from which on the precision holds, and at which itself positives
    are not outnumbered, and the next lower score of any candidate; infinity if there is none."""
    found = {}
    for kind in range(len(KINDS)):
        at: dict[float, list[float]] = {}
        for v, p, n in rows:
            if v[0] == kind:
                group = at.setdefault(sum(evaluate(t, v) for t in trees), [0.0, 0.0])
                group[0] += p
                group[1] += n
        found[kind], pos, neg = math.inf, 0.0, 0.0
        falling = sorted(at.items(), reverse=True)
        for (s, (p, n)), (below, _) in zip(falling, [*falling[1:], falling[-1]], strict=True) if falling else ():
            pos, neg = pos + p, neg + n
            if p and p >= n and pos >= precision * (pos + neg):
                found[kind] = (s + below) / 2
    return found


def _expression(trees: list[tuple], x: Column) -> Column:
    def of(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        f, v, left, right = tree
        return F.when(x[f] <= v, of(left)).otherwise(of(right))

    return sum((of(t) for t in trees), F.lit(0.0))


def held_out_quality(rows: list[tuple[tuple[int, ...], float, float]], trees: list[tuple], limits: dict[int, float]) -> dict[str, tuple[float, float]]:
    """For each kind with a threshold: precision and recall of what passes it."""
    out = {}
    for k, kind in enumerate(KINDS):
        scored = [(sum(evaluate(t, v) for t in trees) >= limits[k], p, n) for v, p, n in rows if v[0] == k] if limits.get(k, math.inf) < math.inf else []
        if scored:
            hit, wrong, every = sum(p for a, p, _ in scored if a), sum(n for a, _, n in scored if a), sum(p for _, p, _ in scored)
            out[kind] = (hit / (hit + wrong), hit / every)
    return out


def fit_model(found: DataFrame, precision: float, taught: int | None = None) -> tuple[list[tuple], dict[int, float], dict[str, tuple[float, float]]]:
    """Trees, the threshold of each kind, and its precision and recall on the documents and the forms that
    the trees have not seen.  A candidate that is neither rewritten nor none for sure counts in the
    calibration as both, in the parts that the trees give it; recall is that of rewritten spans alone."""
    counts = training_vectors(found, taught).groupBy("fold", *FEATURES).agg(F.sum("pos").alias("pos"), F.sum(F.col("sure") * (1 - F.col("pos"))).alias("neg"), F.sum(1 - F.col("sure")).alias("open")).collect()
    halves = [sorted((tuple(r[f] for f in FEATURES), float(r["pos"]), float(r["neg"]), float(r["open"])) for r in counts if r["fold"] == fold) for fold in (0, 1)]
    trees = fit_trees([(v, p, n) for v, p, n, _ in halves[0]])
    part = lambda v: 1 / (1 + math.exp(-sum(evaluate(t, v) for t in trees)))
    limits = calibrate([(v, p + part(v) * o, n + (1 - part(v)) * o) for v, p, n, o in halves[1]], trees, precision) if trees else {}
    return trees, limits, held_out_quality([(v, p, n + (1 - part(v)) * o) for v, p, n, o in halves[1]], trees, limits)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.95, taught: int | None = None) -> DataFrame:
    """``doc_id``, base spans ``email, ip, card, phone`` and ``added`` spans
    ``(kind, s, e)`` for every row; offsets are code points, ends exclusive.

    ``precision`` is that of the added spans on the calibrating half: base spans rewritten in forms
    that the trees have not seen, against the candidates outside base spans (those that are not sure
    count as none in the part that the trees give them).  The trees are fitted on the rewritings of all base spans (of
    about ``taught`` of them, where that is given) and on all candidates outside base spans.  An added span
    touches no base span, and none that scores higher (on a tie, of a kind
    before its own) among those that pass.

    Defined cases: null texts count as empty; texts without candidates have
    empty arrays; texts may be of any length; without base spans there is
    nothing to learn from and nothing is added; repeated rows, null ids and
    empty tables pass through; other columns are ignored, whatever their names.
    """
    found = materialize(propose(docs, id_col, text_col), "pii")
    trees, limits, _ = fit_model(found, precision, taught=taught)
    at_least = {k: v for k, v in limits.items() if v < math.inf}
    # the same sums in the same order as in calibrate(), less a hair
    limit = lambda x: F.coalesce(*(F.when(x["kind"] == k, F.lit(v - 1e-9)) for k, v in at_least.items()), F.lit(math.inf))
    scored = F.transform("candidates", lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), _expression(trees, x).alias("score"))) if at_least else F.array().cast("array<struct<kind:int,s:int,e:int,score:double>>")
    passed = F.filter(scored, lambda x: x["score"] >= limit(x))
    best = best_of(free_of(F.concat(*KINDS), passed))
    first = F.array_sort(F.transform(best, lambda x: F.struct(x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"))))
    return found.select(F.col("id").alias("doc_id"), *KINDS, first.alias("added"))


def _kind_is(k: int):
    return lambda x: x["kind"] == k


def _named(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string")))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    added = [F.filter("added", _kind_is(i)) for i in range(len(KINDS))]
    every = [F.array_sort(F.concat(F.col(k), _spans(more))) for k, more in zip(KINDS, added, strict=True)]
    return found.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(F.concat(*(_named(F.col(k), k) for k in KINDS)), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*(_named(e, k) for e, k in zip(every, KINDS, strict=True))), ",").alias("spans"),
    )
